"""Exact sums over the comparable pairs of linear scores, from O(p) columns a row.

A pair (i, j) is comparable if i is an event and j comes after it: at a later
time, or censored at the same time.  For a score s = w.x and a margin shift a
pair is active if ``s_j > s_i - 1 + shift``.  ``PairRows.evaluate`` returns,
for several (w, shift) at once, the sums over the active pairs of 1,
``1 - s_i + s_j`` and its square, and the gradients and the Hessian of the
latter two.  Every one of them follows from four numbers and vectors a row:
how many later partners an event has with their summed scores and features,
and how many earlier partners a row has.  No pair is listed.

Rows are laid out once by time slots: cut points split the times into open
intervals, and each cut point has two slots of its own (events, censored), so
that a time holding many rows is spread over tasks and has no pairs inside.
At every evaluation cut points split the scores into strips in the same way.
A pair then lies

* inside an open slot: counted in the slot's block, no shuffle;
* in two slots and two strips: read off a table of slots by strips;
* in two slots and one open strip: counted in that strip, to which rows go by
  the only shuffle of an evaluation.

The table has at most (3 MAX_CUTS + 1) x (2 MAX_CUTS + 1) cells of p + 3
numbers a point (25 MB at p = 5); beyond MAX_CUTS x cap rows the blocks grow.
It is joined to the blocks, so that a task holds the lines of one slot, and
points are taken in groups whose tables stay within TABLE_BYTES.
Rows equal in time, event and features are one row with a weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _places

#: Rows of a block, as long as no more than MAX_CUTS cut points are needed.
BLOCK_ROWS = 16_384
MAX_CUTS = 255
#: Rows whose scores place the strips' cut points; they decide balance, not results.
CUT_SAMPLE = 4_096
#: Bytes of the tables of the points that one pass takes together.
TABLE_BYTES = 1 << 27


def dominance_sums(qr, qk, qw, vr, vk, feats):
    """Per query the sum of ``feats`` over values with vr > qr and vk > qk, and
    per value the sum of ``qw`` over queries with qr < vr and qk < vk.

    Ranks are non-negative integers.  One bit of the rank after another: a
    query with the bit off meets the values with the bit on that share the
    higher bits, in one order by key."""
    nv, nq = len(vr), len(qr)
    sums, counts = np.zeros((nq, feats.shape[1])), np.zeros(nv)
    if not nv or not nq:
        return sums, counts
    rank, key = np.concatenate([vr, qr]), np.concatenate([vk, qk])
    isq = np.zeros(nv + nq, dtype=np.int64)
    isq[nv:] = 1
    order = np.lexsort((isq, key))  # a value goes before a query of the same key: they don't pair
    own = np.zeros((nv + nq, feats.shape[1]))
    own[:nv] = feats
    weight = np.zeros(nv + nq)
    weight[nv:] = qw
    for bit in range(int(rank.max()).bit_length()):
        sel = order[((rank[order] >> bit) & 1) != isq[order]]
        if not len(sel):
            continue
        sel = sel[np.argsort(rank[sel] >> (bit + 1), kind="stable")]
        high = rank[sel] >> (bit + 1)
        first = np.concatenate([[True], high[1:] != high[:-1]])
        group, start = np.cumsum(first) - 1, np.flatnonzero(first)
        end = np.concatenate([start[1:], [len(sel)]]) - 1
        q = isq[sel] == 1
        total = np.cumsum(own[sel], axis=0)
        sums[sel[q] - nv] += total[end[group[q]]] - total[q]
        seen = np.cumsum(weight[sel])
        before = seen[start] - weight[sel[start]]
        counts[sel[~q]] += seen[~q] - before[group[~q]]
    return sums, counts


def score(x, w):
    """w.x by one fixed order of additions, the same in every task."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s = s + x[:, k] * w[k]
    return s


def _pair_vector(xq, cq, wq, sums, xv, sv, wv, counts):
    """The pair sums from the rows' partner sums; (count, score, features) are the columns of ``sums``."""
    n, s, x = wq * sums[:, 0], wq * sums[:, 1], sums[:, 2:] * wq[:, None]
    m = wv * counts
    cross = xq.T @ x
    hess = 2 * (xq.T @ (xq * n[:, None]) + xv.T @ (xv * m[:, None]) - cross - cross.T)
    return np.concatenate([
        [n.sum(), (cq * cq * n).sum() + 2 * (cq * s).sum() + (sv * sv * m).sum(), (cq * n).sum() + s.sum()],
        2 * (cq @ x + (sv * m) @ xv - (cq * n + s) @ xq), x.sum(axis=0) - n @ xq, hess.ravel()])


def _residual_vector(t, e, wt, x, s, b):
    """Squared residuals of log time against b - s; a censored row counts where it outlives the prediction."""
    res = np.log(t) + s - b
    res = np.where((e > 0) | (res > 0), res, 0.0)
    z = np.column_stack([x, -np.ones(len(x))])
    live = wt * ((e > 0) | (res > 0))
    return np.concatenate([[(wt * res * res).sum()], 2 * ((wt * res) @ z), 2 * (z.T @ (z * live[:, None])).ravel()])


@dataclass
class PairSums:
    """Sums at one point: active pairs, squares and plain margins with their
    derivatives, and (asked for) the squared residuals with theirs in (w, b)."""

    count: float
    square: float
    linear: float
    square_grad: np.ndarray
    linear_grad: np.ndarray
    square_hess: np.ndarray
    residual: float
    residual_grad: np.ndarray
    residual_hess: np.ndarray

    @classmethod
    def of(cls, v, p):
        cut = np.cumsum([3, p, p, p * p, 1, p + 1])
        head, g2, g1, h, r, rg, rh = np.split(v, cut)
        return cls(*head, g2, g1, h.reshape(p, p), float(r[0]), rg, rh.reshape(p + 1, p + 1))

    def scaled(self, m: float):
        """The sums over all rows as estimated by one row in ``m``: pairs by m squared, residuals by m."""
        pairs = (self.count, self.square, self.linear, self.square_grad, self.linear_grad, self.square_hess)
        rows = (self.residual, self.residual_grad, self.residual_hess)
        return PairSums(*(v * m * m for v in pairs), *(v * m for v in rows))


def _rows(r, p):
    t, e, wt = (np.frombuffer(r[c], dtype=float) for c in ("t", "e", "wt"))
    return t, e, wt, np.frombuffer(r["x"], dtype=float).reshape(-1, p)


def _blocks(batches):
    """The blocks of a task one by one, as views of the Arrow batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: v.as_buffer() if hasattr(v, "as_buffer") else v.as_py()
                   for c, v in ((c, batch.column(c)[i]) for c in batch.schema.names)}


def _sends(second):
    """A maker of the Arrow batches (point, ``second``, v)."""
    import pyarrow as pa

    schema = pa.schema([("point", pa.int32()), (second, pa.int32()), ("v", pa.binary())])
    return lambda point, other, v: pa.record_batch([pa.array(point, pa.int32()), pa.array(other, pa.int32()),
                                                    pa.array(v, pa.binary())], schema=schema)


class PairRows:
    """Rows (time, _e, _x0.._x{p-1}) laid out in time slots for repeated evaluations."""

    def __init__(self, df: DataFrame, p: int, cap: int | None = None):
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        cap = BLOCK_ROWS if cap is None else cap
        names = [f"_x{k}" for k in range(p)]
        d = df.groupBy("time", "_e", *names).agg(F.count(F.lit(1)).cast("double").alias("_wt"))
        d = d.withColumn("_hash", F.xxhash64("time", "_e", *names)).persist()
        self.p, self.n = p, d.count()
        m = min(MAX_CUTS, math.ceil(self.n / cap) - 1)
        cuts = np.array(sorted(set(d.approxQuantile("time", [(i + 1) / (m + 1) for i in range(m)], 0.1 / (m + 1))))
                        if m > 0 else [], dtype=float)
        salts = min(1_024, max(1, math.ceil(self.n / cap)))

        def place(batches):
            for pdf in batches:
                at = np.searchsorted(cuts, pdf["time"], side="left")
                on = cuts[np.minimum(at, len(cuts) - 1)] == pdf["time"].to_numpy() if len(cuts) else np.zeros(len(pdf), bool)
                pdf["slot"] = 3 * at + np.where(on, 1 + (pdf["_e"] <= 0), 0)
                pdf["salt"] = np.where(on, pdf["_hash"] % salts, 0)  # rows on a cut point have no pairs in their slot
                yield pdf

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["time", "_e", "_hash"])
            return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "t": [pdf["time"].to_numpy(float).tobytes()],
                                 "e": [pdf["_e"].to_numpy(float).tobytes()], "wt": [pdf["_wt"].to_numpy(float).tobytes()],
                                 "x": [pdf[names].to_numpy(float).tobytes()]})

        fields = ", ".join(f"{c} {t}" for c, t in d.dtypes)
        packed = d.mapInPandas(place, f"{fields}, slot int, salt int").groupBy("slot", "salt").applyInPandas(
            pack, "slot int, t binary, e binary, wt binary, x binary").persist()  # a checkpoint computes its frame twice
        self.blocks = packed.checkpoint().persist()
        self.blocks.count()
        packed.unpersist()
        self.slots = sorted(r[0] for r in self.blocks.select("slot").distinct().collect())
        self.strips = len(cuts)
        got = d.orderBy("_hash").limit(CUT_SAMPLE).select("_e", *names).toPandas() if len(self.slots) > 1 else None
        self.sample = None if got is None else (got["_e"].to_numpy(), got[names].to_numpy(float))
        d.unpersist()

    def close(self):
        self.blocks.unpersist()

    def _strip_cuts(self, points):
        e, x = self.sample
        share = np.arange(1, self.strips + 1) / (self.strips + 1)
        cuts = []
        for row in points:
            s = score(x, row[:self.p])
            keys = np.concatenate([s, s[e > 0] - 1 + row[self.p]])
            cuts.append(np.unique(np.quantile(keys, share, method="inverted_cdf")))
        return cuts

    def _tables(self, points, cuts):
        """The strips' number and one row a slot, its ``lines``: per point and strip, sums of (weight, score,
        features) over later slots and higher strips, and event weights over earlier slots and lower strips."""
        p, width = self.p, 2 * max(len(c) for c in cuts) + 1

        def cells(batches):
            send = _sends("slot")
            for r in _blocks(batches):
                t, e, wt, x = _rows(r, p)
                for k, row in enumerate(points):
                    s = score(x, row[:p])
                    strip = _places(s, cuts[k])
                    own = [np.bincount(strip, v, width) for v in (wt, wt * s, *(wt * x[:, j] for j in range(p)))]
                    asks = np.bincount(_places(s - 1 + row[p], cuts[k]), wt * (e > 0), width)
                    yield send([k], [r["slot"]], [np.array([*own, asks]).tobytes()])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"point": pdf["point"].iloc[:1], "slot": pdf["slot"].iloc[:1],
                                 "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

        schema = "point int, slot int, v binary"
        table = np.zeros((len(points), len(self.slots), p + 3, width))
        number = {s: i for i, s in enumerate(self.slots)}
        for r in self.blocks.mapInArrow(cells, schema).groupBy("point", "slot").applyInPandas(add, schema).collect():
            table[r["point"], number[r["slot"]]] = np.frombuffer(r["v"]).reshape(p + 3, width)
        for one in table:  # in place, a point at a time
            later, earlier = one[::-1, :-1, ::-1], one[:, -1]
            np.cumsum(later, axis=0, out=later)
            np.cumsum(later, axis=2, out=later)
            later[1:, :, 1:] = later[:-1, :, :-1].copy()
            later[0], later[:, :, 0] = 0, 0
            np.cumsum(earlier, axis=0, out=earlier)
            np.cumsum(earlier, axis=1, out=earlier)
            earlier[1:, 1:] = earlier[:-1, :-1].copy()
            earlier[0], earlier[:, 0] = 0, 0
        lines = pd.DataFrame({"slot": np.array(self.slots, np.int32), "lines": [table[:, i].tobytes() for i in range(len(self.slots))]})
        return width, self.blocks.sparkSession.createDataFrame(lines, "slot int, lines binary")

    def evaluate(self, points, residuals: bool = False) -> list[PairSums]:
        """``points`` has a row (w_0.., shift, b) for each evaluation; b serves the residuals only."""
        p = self.p
        points = np.asarray(points, dtype=float).reshape(-1, p + 2)
        many = len(self.slots) > 1
        group = max(1, TABLE_BYTES // (8 * (len(self.slots) + 1) * (p + 3) * (2 * self.strips + 1)))
        if many and len(points) > group:
            return [r for k in range(0, len(points), group) for r in self.evaluate(points[k:k + group], residuals)]
        cuts = self._strip_cuts(points) if many else None
        width, lines = self._tables(points, cuts) if many else (None, None)
        size = 3 + 2 * p + p * p + 1 + (p + 1) + (p + 1) ** 2
        pair_size = 3 + 2 * p + p * p

        def run(batches):
            send = _sends("strip")
            for r in _blocks(batches):
                t, e, wt, x = _rows(r, p)
                ask = e > 0
                rank = 2 * np.unique(t, return_inverse=True)[1] + (e <= 0)
                table = np.frombuffer(r["lines"]).reshape(len(points), p + 3, width) if many else None
                for k, row in enumerate(points):
                    s = score(x, row[:p])
                    q = s[ask] - 1 + row[p]
                    sums, counts = np.zeros((int(ask.sum()), p + 2)), np.zeros(len(s))
                    if r["slot"] % 3 == 0:
                        own = wt[:, None] * np.column_stack([np.ones(len(s)), s, x])
                        sums, counts = dominance_sums(rank[ask], q, wt[ask], rank, s, own)
                    if many:
                        slot = r["slot"]
                        vs, qs = _places(s, cuts[k]), _places(q, cuts[k])
                        sums = sums + table[k, :-1, qs]
                        counts = counts + table[k, -1, vs]
                        yield _to_strips(send, k, slot, vs, s, s, wt, x, 0)
                        yield _to_strips(send, k, slot, qs, q, s[ask], wt[ask], x[ask], 1)
                    out = np.zeros(size)
                    out[:pair_size] = _pair_vector(x[ask], 1 - s[ask], wt[ask], sums, x, s, wt, counts)
                    if residuals:
                        out[pair_size:] = _residual_vector(t, e, wt, x, s, row[p + 1])
                    yield send([k], [-1], [out.tobytes()])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            if pdf["strip"].iloc[0] < 0:
                out = sum(np.frombuffer(v) for v in pdf["v"])
            else:
                rows = np.concatenate([np.frombuffer(v).reshape(-1, p + 5) for v in pdf["v"]])
                rows = rows[np.lexsort(rows.T)]  # the same sums whatever order the chunks came in
                asks = rows[:, 0] > 0
                v, q = rows[~asks], rows[asks]
                own = v[:, 4:5] * np.column_stack([np.ones(len(v)), v[:, 3], v[:, 5:]])
                sums, counts = dominance_sums(q[:, 1].astype(np.int64), q[:, 2], q[:, 4],
                                              v[:, 1].astype(np.int64), v[:, 2], own)
                out = np.zeros(size)
                out[:pair_size] = _pair_vector(q[:, 5:], 1 - q[:, 3], q[:, 4], sums, v[:, 5:], v[:, 3], v[:, 4], counts)
            return pd.DataFrame({"point": pdf["point"].iloc[:1], "strip": pdf["strip"].iloc[:1], "v": [out.tobytes()]})

        schema = "point int, strip int, v binary"
        blocks = self.blocks.join(F.broadcast(lines), "slot") if many else self.blocks
        parts = blocks.mapInArrow(run, schema)
        if many:
            parts = parts.groupBy("point", "strip").applyInPandas(merge, schema)
        total = np.zeros((len(points), size))
        for r in sorted(parts.collect(), key=lambda r: (r["point"], r["strip"])):  # one row a point and strip
            total[r["point"]] += np.frombuffer(r["v"])
        return [PairSums.of(v, p) for v in total]


def _to_strips(send, k, slot, strip, key, s, wt, x, asks):
    """The rows of open strips as packed chunks (asks, slot, key, score, weight, features), one a strip."""
    rows = np.column_stack([np.full(len(s), float(asks)), np.full(len(s), float(slot)), key, s, wt, x])
    order = np.argsort(strip, kind="stable")
    order = order[strip[order] % 2 == 0]
    found, start = np.unique(strip[order], return_index=True)
    chunks = np.split(rows[order], start[1:]) if len(found) else []
    return send(np.full(len(found), k), found, [c.tobytes() for c in chunks])
