"""Shared kernels.

``cumulative``
    Ordered running sums over a global order, optionally reset per segment.
    Rows are range partitioned on the order key plus a unique tiebreak (so a
    hot key value is split across partitions), summed per range, and the
    ranges' totals (one row per range and segment) become offsets.  Nothing
    of size n reaches the driver or one task, at any size.
``risk_set_table`` (S1)
    Per distinct time: events and sums of weights/values, plus suffix
    ("at risk") sums over time.
``dominance`` (S2)
    Exact weighted count of ordered pairs ``i`` before ``j`` (by a rank) with
    ``s_j < s_i`` and ``s_j == s_i``.  Cut points split ranks into slots and
    scores into strips: pairs inside a slot or a strip are counted in one task
    with numpy, all others read off a table of cells.  No pair is ever
    materialised, and rows are shuffled once at any size.
``gram`` (S3)
    ``X^T W X`` and ``X^T W y`` from per-task blocks; only p x p numbers return.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Broadcast bound for narrow lookup tables (a key and a few doubles, about
# 32 bytes a row): 2M rows stay under ~64 MB.
BROADCAST_ROWS = 2_000_000
DOMINANCE_CAP = 1 << 20
# Rows of a slot of ``dominance``, and the most slots: a table of 513 x 513 cells; more rows make longer slots.
SLOT_ROWS = 1 << 16
DOMINANCE_SLOTS = 256


def _count(df: DataFrame) -> int:
    return int(df.count())


def default_parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_bounds(df: DataFrame, key: str, parts: int | None = None) -> list[float]:
    """Cut points that split the distinct values of a numeric ``key`` evenly.

    An iterative fit takes them once and passes them to every
    ``cumulative`` over a table that has one row per segment and key."""
    parts = default_parts(df) if parts is None else parts
    got = df.select(F.col(key).cast("double").alias("k")).distinct().approxQuantile(
        "k", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted(set(got))


def cumulative(df: DataFrame, order_by: list, sums: dict, *, segment: list | None = None,
               descending: bool = False, exclusive: bool = False,
               parts: int | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Add running sums ``name -> expression`` ordered by ``order_by``.

    One way at every size: rows are range-partitioned on the keys plus a
    unique tiebreak, so a hot key value is spread over partitions; each
    range runs its own sums, and starts after the totals of the ranges
    before it (a table of at most ``parts`` + segments rows).  The ranges
    are frozen by a checkpoint.  With ``bounds`` (see ``key_bounds``) they
    are a function of the key instead and nothing is written; that is for
    tables with one row per segment and key.

    ``descending`` runs the sums from the largest key down (suffix sums).
    ``exclusive`` leaves out the current row.  Rows with equal keys are
    summed in an arbitrary but fixed order, so callers aggregate ties first
    when they need tie-aware sums.  A NULL segment is a segment.
    """
    segment = list(segment or [])
    names = list(sums)
    base = df.select("*", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
                            .cast("double").alias(f"__v_{n}") for n, c in sums.items()])
    okeys = [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]
    if bounds is None:
        parts = default_parts(df) if parts is None else parts
        keys = [F.col(c).asc() for c in segment] + okeys + [F.col("__tb").asc()]
        okeys = okeys + [F.col("__tb").asc()]
        ranged = (base.withColumn("__tb", F.monotonically_increasing_id())
                  .repartitionByRange(parts, *keys).withColumn("__pid", F.spark_partition_id()))
    else:
        at = F.lit(0)
        for b in bounds:
            at = at + F.coalesce((F.col(order_by[0]) >= F.lit(float(b))).cast("int"), F.lit(0))
        ranged = base.withColumn("__tb", F.lit(0)).withColumn("__pid", -at if descending else at)
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    w = Window.partitionBy("__pid", *segment).orderBy(*okeys).rowsBetween(*frame)
    ran = ranged.select("*", *[F.coalesce(F.sum(f"__v_{nm}").over(w), F.lit(0.0)).alias(f"__r_{nm}") for nm in names])
    if bounds is None:
        ran = ran.checkpoint(eager=True)
    tot = ran.groupBy("__pid", *segment).agg(*[F.sum(f"__v_{nm}").alias(f"__t_{nm}") for nm in names])
    wo = Window.partitionBy(*segment).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(F.col("__pid").alias("__op"), *[F.col(c).alias(f"__os_{k}") for k, c in enumerate(segment)], *[
        F.coalesce(F.sum(f"__t_{nm}").over(wo), F.lit(0.0)).alias(f"__o_{nm}") for nm in names])
    same = F.col("__pid") == F.col("__op")
    for k, c in enumerate(segment):
        same = same & F.col(c).eqNullSafe(F.col(f"__os_{k}"))
    return ran.join(offs, same).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in names],
        *[(F.col(f"__r_{nm}") + F.col(f"__o_{nm}")).alias(nm) for nm in names])


# ---------------------------------------------------------------------------
# S1 risk-set sums


def risk_set_table(df: DataFrame, time: str, event: str, sums: dict, event_sums: dict | None = None,
                   **kw) -> DataFrame:
    """Per distinct ``time``: ``d`` events, ``n`` rows, sums of ``sums`` over
    rows and of ``event_sums`` over event rows, and for each ``sums`` entry
    the at-risk sum ``R_<name>`` = sum over rows with time >= this time.
    ``R_n`` is the number at risk.
    """
    event_sums = event_sums or {}
    ev = F.col(event).cast("double")
    aggs = [F.sum(ev).alias("d"), F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(e).cast("double").alias(k) for k, e in sums.items()]
    aggs += [F.sum(F.when(F.col(event) > 0, e)).cast("double").alias(k)
             for k, e in event_sums.items()]
    per_time = df.groupBy(F.col(time).alias("time")).agg(*aggs)
    per_time = per_time.fillna(0.0, subset=list(event_sums))
    suffix = {f"R_{k}": F.col(k) for k in ["n", *sums]}
    return cumulative(per_time, ["time"], suffix, descending=True, **kw)


# ---------------------------------------------------------------------------
# S2 dominance counts


def _inblock_dominance(r: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Sum over pairs rank_i < rank_j of a_i*b_j*[s_j < s_i] and a_i*b_j*[s_j == s_i]."""
    m = len(r)
    if m < 2:
        return 0.0, 0.0
    o = np.argsort(r, kind="stable")
    s, a, b = s[o], a[o], b[o]
    uniq, sr = np.unique(s, return_inverse=True)
    u = np.int64(len(uniq) + 1)
    idx = np.arange(m, dtype=np.int64)
    less = 0.0
    eq = 0.0
    levels = int(math.ceil(math.log2(m)))
    sr = sr.astype(np.int64)
    for k in range(levels):
        block = idx >> (k + 1)
        side = (idx >> k) & 1
        left = side == 0
        right = ~left
        if not right.any():
            continue
        kr = block[right] * u + sr[right]
        ordr = np.argsort(kr, kind="stable")
        kr = kr[ordr]
        cb = np.concatenate([[0.0], np.cumsum(b[right][ordr])])
        kl = block[left] * u + sr[left]
        lo = np.searchsorted(kr, block[left] * u, side="left")
        at = np.searchsorted(kr, kl, side="left")
        hi = np.searchsorted(kr, kl, side="right")
        al = a[left]
        less += float(np.dot(al, cb[at] - cb[lo]))
        eq += float(np.dot(al, cb[hi] - cb[at]))
    return less, eq


#: Least side of the tiles of ``pairs_before``, the most tiles a side, and the pairs compared at a time.
TILE, TILES, COMPARED = 64, 2048, 1 << 17


def dense_classes(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the order of ``a``; equal values, NaN too, share one."""
    return np.unique(a, return_inverse=True)[1].astype(np.int64)


def pairs_before(a: np.ndarray, s: np.ndarray, asks: np.ndarray) -> tuple[float, float]:
    """Pairs of a row i that ``asks`` and a row j with a_j < a_i: how many have s_j < s_i, and how many s_j == s_i.

    Rows get places of their own by a and by s such that a pair counts if both
    places ascend.  Pairs in different tiles of both orders are read off a
    table of counts, pairs inside a tile are compared one by one.  Rows that
    come in the order of ``a`` are not sorted by it."""
    m = len(a)
    if m < 2 or not asks.any():
        return 0.0, 0.0
    asks = np.asarray(asks, bool)
    if not (a[1:] >= a[:-1]).all():
        c = dense_classes(a)
        order = np.argsort(c, kind="stable")
        c, s, asks = c[order], s[order], asks[order]
    else:
        c = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])])
    order = np.argsort(s)
    v = s[order]
    other = v[1:] != v[:-1]
    if v[-1] != v[-1]:  # NaN equals NaN here
        other &= (v[1:] == v[1:]) | (v[:-1] == v[:-1])
    y = np.empty(m, np.int64)
    y[order] = np.concatenate([[0], np.cumsum(other)])
    equal, tied, at = 0.0, not other.all(), np.arange(m)
    if tied:
        key = np.sort((y << 32) | (c << 1) | asks)
        start = np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1])
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        before = np.maximum.accumulate(np.where(start, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        equal = float(before[(key & 1) == 1].sum())
    if c[-1] + 1 < m:  # of one class no later row has the larger score
        key = np.sort((c << 33) | ((m - 1 - y) << 1) | asks)
        y, asks = m - 1 - ((key >> 1) & 0xFFFFFFFF), (key & 1) == 1
    if tied:  # of one score no later row has the larger place
        order = np.argsort((y << 32) | (m - 1 - at))
        y = np.empty(m, np.int64)
        y[order] = at
    return _ascending(y.astype(np.int32), asks), equal


def _ascending(y: np.ndarray, asks: np.ndarray) -> float:
    """Pairs j < i of places with y_j < y_i where i asks; ``y`` is a permutation."""
    n, tile, less = len(y), TILE, 0.0
    while n > tile * TILES:
        tile *= 2
    c = -(-n // tile)
    if c > 1:
        cx, cy = np.arange(n) // tile, y // tile
        table = np.bincount(cx * c + cy, minlength=c * c).astype(np.int32).reshape(c, c)
        np.cumsum(table, axis=0, out=table)
        np.cumsum(table, axis=1, out=table)
        q = asks & (cx > 0) & (cy > 0)
        less = float(table[cx[q] - 1, cy[q] - 1].sum(dtype=np.int64))
        del table
    # the same tile of the first order, then the same tile of the second one in different tiles of the first; narrow
    # places inside a tile compare fastest
    inside = np.full(c * tile, np.iinfo(np.int32).max, np.int32)
    inside[:n] = y
    sorted_, places = np.argsort(inside.reshape(c, tile), axis=1), np.empty((c, tile), np.uint8 if tile <= 256 else np.uint16)
    np.put_along_axis(places, sorted_, np.arange(tile, dtype=places.dtype)[None], axis=1)
    less += _inside_tiles(places.ravel()[:n], asks, tile)
    if c > 1:
        by_y = np.empty(n, np.int32)
        by_y[y] = np.arange(n, dtype=np.int32)
        less += _inside_tiles((by_y // tile).astype(np.uint8 if c <= 256 else np.uint16), asks[by_y], tile)
    return less


def _inside_tiles(key: np.ndarray, asks: np.ndarray, tile: int) -> float:
    """Pairs j < i of one tile with key_j < key_i where i asks: a row is compared with those 1, 2, ... rows before it, tiles side by side."""
    n, most, less = len(key), np.iinfo(key.dtype).max, 0.0
    wide = max(1, COMPARED // tile)
    out = np.empty(wide * tile, bool)
    for k in range(0, -(-n // tile), wide):
        g = min(wide, -(-n // tile) - k)
        v, w = np.full(g * tile, most, key.dtype), np.zeros(g * tile, key.dtype)
        own = slice(k * tile, min(n, (k + g) * tile))
        v[:own.stop - own.start], w[:own.stop - own.start] = key[own], np.where(asks[own], key[own], 0)
        v, w = (np.ascontiguousarray(x.reshape(g, tile).T).ravel() for x in (v, w))
        for d in range(g, g * tile, g):
            less += np.count_nonzero(np.less(v[:-d], w[d:], out=out[:len(v) - d]))
    return less


#: Share of the rows from which on another score of the same rows is counted anew by ``pairs_of_scores``.
ANEW = 0.4


def _alike(s: np.ndarray, order: np.ndarray) -> bool:
    """Whether most of some neighbours in ``order`` are in the order of ``s`` too (it decides what is counted how, not results)."""
    at = np.linspace(0, len(s) - 2, min(len(s) - 1, 4096)).astype(int)
    return np.mean(s[order[at]] <= s[order[at + 1]]) > 0.75


def pairs_of_scores(a: np.ndarray, scores, asks: np.ndarray) -> list[tuple[float, float]]:
    """``pairs_before`` of several scores of the same rows, each from the one before it where their orders are much alike.

    The rows in the order of one score fall into runs between which the next
    score keeps that order, strictly.  Pairs of two runs count the same for
    both scores, so only the rows of runs in which an order changes are counted, for both."""
    out, last = [], None
    for s in scores:
        got = None
        if last is not None and len(s) > 1 and _alike(s, order):
            q, t = last[order], s[order]
            clean = (np.maximum.accumulate(t)[:-1] < np.minimum.accumulate(t[::-1])[::-1][1:]) & (q[:-1] < q[1:])
            start = np.concatenate([[0], np.flatnonzero(clean) + 1])
            size = np.diff(np.append(start, len(s)))
            end = start + size - 1
            same = (q[start] == q[end]) & (np.minimum.reduceat(t, start) == np.maximum.reduceat(t, start))
            rows = order[np.repeat(~same, size)]
            if len(rows) <= ANEW * len(s):
                rows = np.sort(rows)
                was, now = (pairs_before(a[rows], v[rows], asks[rows]) for v in (last, s))
                got = out[-1][0] + now[0] - was[0], out[-1][1] + now[1] - was[1]
        out.append(pairs_before(a, s, asks) if got is None else got)
        if got is None or len(rows):
            order, last = np.argsort(s), s
    return out


def _block_pairs(r: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The sums of ``_inblock_dominance`` where ranks may be tied: equal ranks are no pair."""
    if len(r) < 2:
        return 0.0, 0.0
    if (b == 1).all() and ((a == 0) | (a == 1)).all():
        return pairs_before(-r, s, a > 0)
    s = np.unique(s, return_inverse=True)[1]
    o = np.lexsort((s, r))  # of equal ranks no later row has the lower score
    r, s, a, b = r[o], s[o], a[o], b[o]
    less, eq = _inblock_dominance(np.arange(len(r)), s, a, b)
    last = np.append((r[1:] != r[:-1]) | (s[1:] != s[:-1]), True)
    seen, ends = np.cumsum(b), np.flatnonzero(last)
    own = seen[ends[np.searchsorted(ends, np.arange(len(r)))]] - seen  # later rows of the same rank and score
    return less, eq - float(np.dot(a, own))


def _places(v, cuts):
    """Place of each value: 2k between cut points, 2k + 1 on the k-th."""
    at = np.searchsorted(cuts, v, side="left")
    return 2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == v) if len(cuts) else at


def dominance(df: DataFrame, rank: str, score: str, a: str, b: str, *, n_rows: int,
              cap: int | None = None, dense: bool = True, parts: int | None = None) -> tuple[float, float]:
    """Exact ``(sum a_i b_j [s_j<s_i], sum a_i b_j [s_j==s_i])`` over pairs with ``rank_i < rank_j``.

    ``rank`` is a dense 0..n-1 row rank, or with ``dense=False`` any number, ties included.  Cut points split the
    ranks into slots and the scores into strips, at most DOMINANCE_SLOTS of each; a cut point is a slot (strip)
    of its own, which has no unequal pairs inside.  Pairs of two slots and two strips, or of two slots on one
    score, are read off a table of cells, the others are counted inside a slot or inside a strip, to which rows
    go by one shuffle at any size."""
    cap = SLOT_ROWS if cap is None else cap
    base = df.select(F.col(rank).cast("double").alias("r"), F.col(score).cast("double").alias("s"),
                     F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    m = min(DOMINANCE_SLOTS, math.ceil(n_rows / cap)) - 1
    slots = strips = np.zeros(0)
    if m > 0:
        found = base.approxQuantile(["s"] if dense else ["s", "r"], [(i + 1) / (m + 1) for i in range(m)], 0.2 / (m + 1))
        strips = np.unique(found[0])
        slots = np.arange(1, m + 1) * math.ceil(n_rows / (m + 1)) - 0.5 if dense else np.unique(found[1])
    high, wide = 2 * len(slots) + 1, 2 * len(strips) + 1

    def cells(batches):
        total, size = {}, high * wide
        for pdf in batches:
            cell, at = np.unique(_places(pdf["r"].to_numpy(), slots) * wide + _places(pdf["s"].to_numpy(), strips),
                                 return_inverse=True)
            if not total:
                total = {n: np.zeros(size) for n in ("n", "a", "b")}
            total["n"][cell] += np.bincount(at)
            for n in ("a", "b"):
                total[n][cell] += np.bincount(at, pdf[n].to_numpy(float))
        if total:
            on = np.flatnonzero(total["n"])
            yield pd.DataFrame({"cell": on, "a": total["a"][on], "b": total["b"][on]})

    def deal(batches):
        for pdf in batches:
            slot, strip = _places(pdf["r"].to_numpy(), slots), _places(pdf["s"].to_numpy(), strips)
            pdf["grp"] = slot
            yield pdf[slot % 2 == 0]
            if m > 0:
                pdf["grp"], pdf["r"] = -1 - strip, slot.astype(float)
                yield pdf[strip % 2 == 0]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, eqv = _block_pairs(*(pdf[c].to_numpy() for c in ("r", "s", "a", "b")))
        return pd.DataFrame({"l": [lo], "e": [eqv]})

    if m > 0:
        got = base.mapInPandas(cells, "cell long, a double, b double").groupBy("cell").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # at most one row a cell
        A, B = np.zeros(high * wide), np.zeros(high * wide)
        A[got["cell"]], B[got["cell"]] = got["a"], got["b"]
        A, B = A.reshape(high, wide), B.reshape(high, wide)
        later = B[::-1].cumsum(0)[::-1][1:]
        less = float((A[:-1, 1:] * later.cumsum(1)[:, :-1]).sum())
        eq = float((A[:-1, 1::2] * later[:, 1::2]).sum())
    else:
        less = eq = 0.0
    res = (base.mapInPandas(deal, "r double, s double, a double, b double, grp int")
           .groupBy("grp").applyInPandas(inside, "l double, e double")
           .agg(F.sum("l").alias("l"), F.sum("e").alias("e")).first())
    return less + float(res["l"] or 0.0), eq + float(res["e"] or 0.0)


def dense_rank_global(df: DataFrame, order: list, name: str = "rank",
                      parts: int | None = None) -> tuple[DataFrame, int]:
    """0-based unique row rank over ``order`` (list of Columns/names, asc),
    computed with the distributed cumulative (no single-partition window
    for large inputs)."""
    n = _count(df)
    cols = []
    tmp = df
    for i, o in enumerate(order):
        if isinstance(o, str):
            cols.append(o)
        else:
            nm = f"__ord{i}"
            tmp = tmp.withColumn(nm, o)
            cols.append(nm)
    out = cumulative(tmp, cols, {name: F.lit(1.0)}, exclusive=True, parts=parts)
    out = out.withColumn(name, F.col(name).cast("long"))
    return out.drop(*[c for c in cols if c.startswith("__ord")]), n


def bucket_fold(df: DataFrame, key: str, bucket: str, sums: dict, run: str, width: int, fold, size: int,
                descending: bool = False, exclusive: bool = False, parts: int | None = None) -> np.ndarray:
    """Sum of ``fold({name: keys x width sums}, running sums of ``run``)`` over the distinct values of ``key`` in order.

    ``bucket`` numbers the columns, 0 to width - 1.  Rows collapse to one a
    (key, bucket), keys are range-partitioned, and only a task's current chunk
    of keys is a dense matrix.  The ranges' totals (parts x width numbers)
    give where each range starts.  Null keys are one key before all others,
    NaN one after them."""
    parts, names = default_parts(df) if parts is None else parts, list(sums)
    k = F.col(key).cast("double")
    kind = F.when(k.isNull(), 0).when(F.isnan(k), 2).otherwise(1)
    agg = df.groupBy(kind.alias("_kind"), F.nanvl(F.coalesce(k, F.lit(0.0)), F.lit(0.0)).alias("_key"),
                     F.col(bucket).cast("int").alias("_b")).agg(
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    order = [F.desc(c) if descending else F.asc(c) for c in ("_kind", "_key")]
    ran = agg.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = {}
    for r in ran.groupBy("_pid", "_b").agg(F.sum(run).alias("v")).collect():
        totals.setdefault(r["_pid"], np.zeros(width))[r["_b"]] = r["v"]
    starts, at = {}, np.zeros(width)
    for pid in sorted(totals):
        starts[pid] = at
        at = at + totals[pid]

    def task(batches):
        total, seen, held = np.zeros(size), None, None

        def take(rows, new):
            nonlocal total, seen
            number = np.cumsum(new) - 1
            dense = {n: np.zeros((number[-1] + 1, width)) for n in names}
            for n, m in dense.items():
                m[number, rows["_b"].to_numpy()] = rows[n].to_numpy()
            after = seen + np.cumsum(dense[run], axis=0)
            total = total + fold(dense, after - dense[run] if exclusive else after)
            seen = after[-1]

        for pdf in batches:
            if not len(pdf):
                continue
            seen = starts[int(pdf["_pid"].iloc[0])] if seen is None else seen
            rows = pdf if held is None else pd.concat([held, pdf])
            keys = rows[["_kind", "_key"]].to_numpy()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            last = np.flatnonzero(new)[-1]  # the last key may go on in the next batch
            if last:
                take(rows.iloc[:last], new[:last])
            held = rows.iloc[last:]
        if held is not None:
            take(held, np.arange(len(held)) == 0)
        yield pd.DataFrame({"v": [total.tolist()]})

    got = ran.mapInPandas(task, "v array<double>").collect()  # one row a partition
    return np.sum([r["v"] for r in got], axis=0) if got else np.zeros(size)


# ---------------------------------------------------------------------------
# S3 Gram


def gram(df: DataFrame, cols: list[str], weight: Column | str | None = None,
         y: Column | str | None = None) -> tuple[np.ndarray, np.ndarray | None, float]:
    """``X^T W X`` (p x p), ``X^T W y`` and ``sum W`` from per-task blocks."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    p = len(cols)
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    yy = F.lit(0.0) if y is None else (F.col(y) if isinstance(y, str) else y)
    sides = df.select(*[(w * x).alias(f"a{i}") for i, x in enumerate(xs)], w.cast("double").alias(f"a{p}"),
                      *[x.alias(f"b{i}") for i, x in enumerate(xs)], yy.cast("double").alias(f"b{p}"),
                      F.lit(1.0).alias(f"b{p + 1}"))
    out = outer_sum(sides, [f"a{i}" for i in range(p + 1)], [f"b{i}" for i in range(p + 2)])
    return out[:p, :p], None if y is None else out[:p, p], float(out[p, p + 1])


# ---------------------------------------------------------------------------
# S2 with margins and vector sums (pairwise SVM gradients)


def dominance_grouped(df: DataFrame, group: str, rank: str, score: str, a: str, b: str, *,
                      max_rows: int, cap: int | None = None, **kw) -> DataFrame:
    """``dominance`` for many independent groups at once (e.g. one C-index
    per (fold, candidate)).  ``rank`` is the 0-based rank within the group;
    ``max_rows`` the largest group size.  Returns (group, l, e)."""
    cap = DOMINANCE_CAP if cap is None else cap
    lcap = max(1, int(math.floor(math.log2(cap))))
    top = int(math.ceil(math.log2(max(max_rows, 2))))
    base = df.select(F.col(group).alias("g"), F.col(rank).cast("long").alias("r"),
                     F.col(score).cast("double").alias("s"),
                     F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    parts = []
    for k in range(lcap, top):
        lv = base.select("g", F.shiftright("r", k + 1).alias("blk"), "s",
                         F.when((F.shiftright("r", k) % 2) == 0, F.col("a")).otherwise(0.0).alias("A"),
                         F.when((F.shiftright("r", k) % 2) == 1, F.col("b")).otherwise(0.0).alias("B"))
        agg = lv.groupBy("g", "blk", "s").agg(F.sum("A").alias("A"), F.sum("B").alias("B"))
        cum = cumulative(agg, ["s"], {"Bless": "B"}, segment=["g", "blk"], exclusive=True, **kw)
        parts.append(cum.groupBy("g").agg(F.sum(F.col("A") * F.col("Bless")).alias("l"),
                                          F.sum(F.col("A") * F.col("B")).alias("e")))

    def inblock(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, eqv = _inblock_dominance(pdf["r"].to_numpy(), pdf["s"].to_numpy(),
                                     pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "l": [lo], "e": [eqv]})

    gtype = base.schema["g"].dataType.simpleString()
    ib = base.withColumn("blk", F.shiftright("r", lcap)).groupBy("g", "blk") \
        .applyInPandas(inblock, f"g {gtype}, l double, e double")
    out = ib
    for p_ in parts:
        out = out.unionByName(p_)
    return out.groupBy("g").agg(F.sum("l").alias("l"), F.sum("e").alias("e"))


def outer_sum(df: DataFrame, a_cols: list[str], b_cols: list[str]) -> np.ndarray:
    """``sum_rows outer(A_row, B_row)`` (ka x kb): one numpy partial per
    partition (Arrow batches), then a sum over the partials.  Replaces a
    ka*kb-column aggregation, whose generated code grows with ka*kb."""
    ka, kb = len(a_cols), len(b_cols)

    def part(it):
        acc = np.zeros((ka, kb))
        for pdf in it:
            if len(pdf):
                acc += pdf[a_cols].to_numpy(dtype=float).T @ pdf[b_cols].to_numpy(dtype=float)
        yield pd.DataFrame({"s": [acc.ravel().tolist()]})

    parts = df.select(*dict.fromkeys([*a_cols, *b_cols])).mapInPandas(part, "s array<double>")
    tot = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(ka * kb)
    for r in tot:
        out[int(r["i"])] = r["x"]
    return out.reshape(ka, kb)
