"""Gradient boosting with the Cox loss.

``componentwise``  (CGBS): the learner is linear, so the model is a
    coefficient vector; each step needs only the Cox gradient U(beta) =
    X' r (r = martingale-type residuals) from one risk-set pass, then picks
    the component with the largest (x_k' r)^2 / ||x_k||^2 and adds
    learning_rate * x_k' r / ||x_k||^2.  An intercept component is kept as in
    the reference (its gradient is always 0).
``trees``  (GBS): regression trees, grown by the rules of Spark ML, fitted to
    the residuals r_i = e_i - exp(F_i) * A(t_i), A(t) = sum over event times
    <= t of d/S0, each step; binned rows stay in blocks of falling time, and
    a level of a tree is one pass over them that returns sums by bin.
Staged prediction (row 70) is the score after each step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import default_parts
from .resident import BLOCK_ROWS, Models, ResidentRows

#: Blocks of a large table, besides one for each partition: what the driver holds of a pass is that many tables of sums by bin.
MAX_BLOCKS = 256
#: Trees after which the rows' scores are kept anew.
REFRESH = 10
#: Rows whose values give the candidate thresholds (Spark ML's number).
SPLIT_ROWS = 10_000


def componentwise(df: DataFrame, features: list[str], n_estimators: int = 100, learning_rate: float = 0.1,
                  subsample: float = 1.0, seed: int = 0, id_col: str | None = None,
                  time: str = "time", event: str = "event") -> pd.DataFrame:
    """Row 67: returns the coefficient path (step, feature, coef).

    Rows are laid out once by time; with a subsample each carries the list of
    the steps that take it.  A step is one pass over the resident blocks."""
    p, steps = len(features), range(1, n_estimators + 1)
    sampled = subsample < 1.0 and id_col is not None
    xc = [f"x{k}" for k in range(p)]
    base = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                     *([F.col(id_col).alias("_id")] if id_col else []),
                     *[F.col(f"`{c}`").cast("double").alias(x) for x, c in zip(xc, features, strict=True)]).dropna()
    own = F.array(F.lit(0))
    if sampled:
        own = F.filter(F.array(*[F.lit(step) for step in steps]), lambda step: (
            (F.col("_id").cast("long") + 1) * (F.lit(7919 + seed) + step * 1000)) % 1000003 < int(subsample * 1000003))
    base = base.select("time", "event", *xc, own.alias("own")).persist()
    sums = base.select(F.explode("own").alias("own"), *xc).groupBy("own").agg(
        *[F.sum(F.col(x) * F.col(x)).alias(x) for x in xc]).collect()  # one row a step
    norms = {r["own"]: np.array([r[x] for x in xc]) for r in sums}
    blocks = ResidentRows(base, xc, trains="own")
    base.unpersist()
    beta, rows = np.zeros(p), []
    for step in steps:
        key = step if sampled else 0
        norm = norms.get(key, np.zeros(p))
        if key in blocks.fold_index:
            model = Models(np.array([blocks.fold_index[key]]), np.zeros(1), np.zeros(1, bool), np.ones((1, p), bool))
            _, U, _ = blocks.evaluate(model, beta[None], information=False)
            gain = U[0] * U[0] / np.where(norm > 0, norm, np.inf)
            k = int(np.argmax(gain))
            if norm[k] > 0:
                beta[k] += learning_rate * U[0, k] / norm[k]
        rows += [(step, f, float(beta[j])) for j, f in enumerate(features)]
    blocks.close()
    return pd.DataFrame(rows, columns=["step", "feature", "coef"])


def staged_scores(df: DataFrame, path: pd.DataFrame, steps: list[int], keys: list[str]) -> DataFrame:
    """Row 70: score after each requested step, one row per (row, step);
    the per-step coefficient vectors are literals (steps x p numbers)."""
    feats = list(dict.fromkeys(path["feature"]))
    structs = []
    for s in steps:
        sub = path[path["step"] == s].set_index("feature")["coef"]
        e = F.lit(0.0)
        for f in feats:
            e = e + F.col(f"`{f}`").cast("double") * F.lit(float(sub[f]))
        structs.append(F.struct(F.lit(s).alias("step"), e.alias("score")))
    return df.select(*keys, F.explode(F.array(*structs)).alias("_s")).select(*keys, "_s.step", "_s.score")


@dataclass
class Tree:
    """A regression tree as a complete tree: the children of node k are 2k + 1 (x <= threshold) and 2k + 2.

    A node that was not split has an infinite threshold, so that its rows keep
    left; ``value`` has the prediction of every place of the last level."""

    feature: np.ndarray
    cut: np.ndarray        # bin of the split: rows of higher bins go right
    threshold: np.ndarray
    value: np.ndarray
    importances: np.ndarray

    @property
    def featureImportances(self):  # noqa: N802 - the name of Spark ML's models
        from pyspark.ml.linalg import Vectors

        return Vectors.dense(self.importances)

    def predict(self, columns: list):
        """Predictions of rows given by feature columns."""
        return self.value[_places(self.feature, self.threshold, columns, len(columns[0]))]


def _places(feature, cut, columns, n: int):
    """Places of ``n`` rows on the level under the given nodes (a complete tree's)."""
    at = np.zeros(n, np.int32)
    level, first = 0, 0
    while first < len(feature):
        right = np.zeros(n, bool)
        for k in range(1 << level):
            node = first + k
            if np.isfinite(cut[node]):
                right |= (at == k) & (columns[feature[node]] > cut[node])
        at = 2 * at + right
        first, level = first + (1 << level), level + 1
    return at


def _thresholds(base: DataFrame, xc: list[str], n: int, max_bins: int) -> list[np.ndarray]:
    """Candidate thresholds of every feature, by the rule of Spark ML's trees.

    As there, values are counted on all rows up to ``max(max_bins^2, SPLIT_ROWS)``, and on about
    as many drawn ones of a larger table; the trees themselves are fitted to every row."""
    wanted = max(max_bins * max_bins, SPLIT_ROWS)
    share = min(1.0, wanted / n)
    got = (base if share >= 1 else base.sample(withReplacement=False, fraction=share, seed=17)).select(*xc).toPandas()
    out, weight, most = [], share * n, min(max_bins, n) - 1
    for x in xc:
        values, counts = np.unique(got[x].to_numpy(float) + 0.0, return_counts=True)
        zeros = weight - counts[values != 0].sum()  # zeros count as what the drawn rows leave of the expected number
        keep = values != 0
        values, counts = values[keep], counts[keep].astype(float)
        if zeros > np.finfo(float).eps * max(1, len(got)) * 100:
            at = np.searchsorted(values, 0.0)
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > most:
            stride, picked, before = weight / (most + 1), [], counts[0] if len(counts) else 0.0
            goal = stride
            for k in range(1, len(values)):
                now = before + counts[k]
                if abs(before - goal) < abs(now - goal):
                    picked.append(middle[k - 1])
                    goal += stride
                before = now
            middle = np.array(picked)
        out.append(middle)
    return out


class _BoostRows:
    """Binned rows in blocks of falling time, with their scores after the trees so far.

    A block needs one number from the others for its risk sets, the weights of
    all later times, and one for its hazards, those of all earlier times.  A
    time that spans blocks is owned by the last block that holds it, which
    then has the whole risk set before it."""

    def __init__(self, base: DataFrame, xc: list[str], n: int, cuts: list[np.ndarray], rate: float):
        # a pass is short, so a small table takes no more tasks than it has full blocks
        rows = ResidentRows(base, xc, parts=min(default_parts(base), -(-n // BLOCK_ROWS)), block_rows=max(BLOCK_ROWS, -(-n // MAX_BLOCKS)))
        self.cuts, self.rate, p = cuts, rate, len(xc)
        self.bins = [len(c) + 1 for c in cuts]
        self.starts = np.concatenate(([0], np.cumsum(self.bins)))
        self.kind = "<u1" if max(self.bins) <= 256 else "<u2"
        self.blocks, self.n = [m[0] for m in rows.meta], np.array([m[1] for m in rows.meta], float)
        leaves = {m[0] for m, later in zip(rows.meta, rows.meta[1:], strict=False) if m[3] == later[2]}
        kind = self.kind

        def binned(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    time, x = np.frombuffer(r.time, "<f8"), np.frombuffer(r.x, "<f8").reshape(r.n, p)
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(time)) + 1)).astype("<i8")
                    dies = np.add.reduceat(np.frombuffer(r.event, np.uint8).astype("<i8"), starts)
                    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(kind)
                    yield pd.DataFrame({"block": [r.block], "n": [r.n], "starts": [starts.tobytes()], "dies": [dies.tobytes()],
                                        "event": [r.event], "bins": [bins.tobytes()]})

        self.rows = rows.blocks.mapInPandas(
            binned, "block long, n int, starts binary, dies binary, event binary, bins binary").persist()
        # deaths at a time that spans blocks, all given to its last block
        first, run = {}, 0
        ends = {}
        for r in self.rows.mapInPandas(_edge_deaths, "block long, groups long, first long, last long").collect():
            ends[r["block"]] = r
        for b in self.blocks:
            r, first[b] = ends[b], run
            run = (r["last"] + (run if r["groups"] == 1 else 0)) if b in leaves else 0
        self.first, self.leaves, self.state, self.trees, self.done = first, leaves, None, [], 0
        rows.close()
        self._refresh()

    def _refresh(self):
        """The scores after all trees, kept beside the rows; always from the rows, so that no chain of steps builds up."""
        trees, p, kind, rate = [(t.feature, t.cut, t.value) for t in self.trees], len(self.cuts), self.kind, self.rate

        def scored(batches):
            for pdf in batches:
                yield pdf.assign(score=[_scores(np.zeros(r.n), trees, np.frombuffer(r.bins, kind).reshape(p, r.n), rate).tobytes()
                                        for r in pdf.itertuples(index=False)])

        state = self.rows.mapInPandas(scored, "block long, n int, starts binary, dies binary, event binary, bins binary, "
                                              "score binary").persist()
        state.count()
        if self.state is not None:
            self.state.unpersist()
        self.state, self.done = state, len(self.trees)

    def add(self, tree: Tree):
        self.trees.append(tree)
        if len(self.trees) - self.done >= REFRESH:
            self._refresh()

    def close(self):
        self.state.unpersist()
        self.rows.unpersist()

    def level(self, feature, cut, before: np.ndarray, off: np.ndarray | None):
        """Sums of every block by place on the next level of the tree, feature and bin.

        With the hazards ``off`` of the blocks of earlier times: rows, residuals, their squares and weights.
        Without them: the block's hazards, and rows, u, w, u^2, uw and w^2, where the residual is u - off w."""
        pending = [(t.feature, t.cut, t.value) for t in self.trees[self.done:]]
        p, kind, rate, bins, starts, first, leaves = len(self.cuts), self.kind, self.rate, self.bins, self.starts, self.first, self.leaves
        given = {b: (before[i], 0.0 if off is None else off[i]) for i, b in enumerate(self.blocks)}
        places, plain = len(feature) + 1, off is not None

        def sums(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    x = np.frombuffer(r.bins, kind).reshape(p, r.n)
                    w = np.exp(_scores(np.frombuffer(r.score, "<f8"), pending, x, rate))
                    begins, d = np.frombuffer(r.starts, "<i8"), np.frombuffer(r.dies, "<i8").astype(float)
                    d[0] += first[r.block]
                    if r.block in leaves:
                        d[-1] = 0.0
                    s0 = given[r.block][0] + np.cumsum(np.add.reduceat(w, begins))
                    hazard = np.cumsum(np.divide(d, s0, out=np.zeros(len(d)), where=d > 0)[::-1])[::-1]
                    a = np.repeat(hazard + given[r.block][1], np.diff(np.append(begins, r.n)))
                    u = np.frombuffer(r.event, np.uint8) - w * a
                    at = _places(feature, cut, x, r.n)
                    stats = (u, u * u, w) if plain else (u, w, u * u, u * w, w * w)
                    out = np.zeros((1 + len(stats), places, starts[-1]))
                    for j in range(p):
                        key, here = at * bins[j] + x[j], slice(starts[j], starts[j + 1])
                        for k, v in enumerate((None, *stats)):
                            out[k, :, here] = np.bincount(key, v, places * bins[j]).reshape(places, bins[j])
                    yield pd.DataFrame({"block": [r.block], "hazard": [float(hazard[0])], "sums": [out.tobytes()]})

        got = {r["block"]: r for r in self.state.mapInPandas(sums, "block long, hazard double, sums binary").collect()}
        shape = (-1, places, starts[-1])
        return (np.array([got[b]["hazard"] for b in self.blocks]),
                np.stack([np.frombuffer(got[b]["sums"], "<f8").reshape(shape) for b in self.blocks]))


def _edge_deaths(batches):
    """Number of times of a block, and the deaths at its first and at its last time."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            d = np.frombuffer(r.dies, "<i8")
            yield pd.DataFrame({"block": [r.block], "groups": [len(d)], "first": [d[0]], "last": [d[-1]]})


def _scores(score, trees, columns, rate: float):
    for feature, cut, value in trees:
        score = score + rate * value[_places(feature, cut, columns, len(score))]
    return score


def _impurity(n, s, q):
    n1 = np.where(n > 0, n, 1.0)
    return np.where(n > 0, (q - s * s / n1) / n1, 0.0)


def _best_split(sums, starts, min_instances: int):
    """(gain, feature, bin, left, right) of the split of largest gain, the first of equal ones; None without a gain.

    ``sums`` has rows, residuals and their squares by bin, features one after another."""
    best = None
    for j in range(len(starts) - 1):
        run = np.cumsum(sums[:, starts[j]:starts[j + 1]], axis=1)
        left, whole = run[:, :-1], run[:, -1]
        if not left.shape[1]:
            continue
        right = whole[:, None] - left
        gain = _impurity(*whole) - left[0] / whole[0] * _impurity(*left) - right[0] / whole[0] * _impurity(*right)
        gain = np.where((left[0] < min_instances) | (right[0] < min_instances), -np.inf, gain)
        k = int(np.argmax(gain))
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), j, k, left[:, k], right[:, k]
    return best


def _grow(rows: _BoostRows, weights: np.ndarray, max_depth: int, min_instances: int):
    """One tree on the residuals, by variance as Spark ML grows it, and the blocks' weights after it.

    A level is one pass over the resident blocks, whose sums by place, feature and bin come back."""
    starts, p, size = rows.starts, len(rows.cuts), (1 << max_depth) - 1
    feature, cut, threshold = np.zeros(size, int), np.full(size, np.inf), np.full(size, np.inf)
    value, gains, off = np.zeros(size + 1), np.zeros(p), None
    before, open_nodes, predicted = np.concatenate(([0.0], np.cumsum(weights)[:-1])), {0}, {}
    for level in range(max(1, max_depth)):
        base = (1 << level) - 1
        hazard, got = rows.level(feature[:base], cut[:base], before, off)
        if off is None:
            off = np.concatenate((np.cumsum(hazard[::-1])[::-1][1:], [0.0]))
            o = off[:, None, None]
            n, u, w, uu, uw, ww = (got[:, k] for k in range(6))
            sums, held = np.stack([n.sum(0), (u - o * w).sum(0), (uu - 2 * o * uw + o * o * ww).sum(0)]), w
        else:
            sums, held = got[:, :3].sum(0), got[:, 3]
        if level == 0:
            whole = sums[:, 0, starts[0]:starts[1]].sum(axis=1)
            predicted[0] = whole[1] / whole[0]
        nexts = set()
        for node in sorted(open_nodes):
            if node < base or level >= max_depth:
                continue
            found = _best_split(sums[:, node - base], starts, min_instances)
            if found is None:
                continue
            gain, j, k, left, right = found
            feature[node], cut[node], threshold[node] = j, k, rows.cuts[j][k]
            gains[j] += gain * (left[0] + right[0])
            for child, own in ((2 * node + 1, left), (2 * node + 2, right)):
                predicted[child] = own[1] / own[0]
                if level + 1 < max_depth and abs(_impurity(*own)) >= np.finfo(float).eps:
                    nexts.add(child)
        open_nodes = nexts
        if not open_nodes:
            break
    after = np.zeros(len(weights))
    for k in range(1 << level):
        node, own = base + k, held[:, k]
        shares = {node: own[:, :starts[1]].sum(axis=1)}
        if node < size and np.isfinite(cut[node]):
            left = own[:, starts[feature[node]]:starts[feature[node]] + int(cut[node]) + 1].sum(axis=1)
            right = own[:, starts[feature[node]] + int(cut[node]) + 1:starts[feature[node] + 1]].sum(axis=1)
            shares = {2 * node + 1: left, 2 * node + 2: right}
        for at, share in shares.items():
            while at not in predicted:  # a place below a leaf
                at = (at - 1) // 2
            after += share * np.exp(rows.rate * predicted[at])
    for k in range(size + 1):
        at = size + k
        while at not in predicted:
            at = (at - 1) // 2
        value[k] = predicted[at]
    total = gains.sum()
    return Tree(feature, cut, threshold, value, gains / total if total > 0 else gains), after


def trees(df: DataFrame, features: list[str], n_estimators: int = 100, learning_rate: float = 0.1,
          max_depth: int = 3, min_instances: int = 1, max_bins: int = 32, id_col: str = "id",
          time: str = "time", event: str = "event"):
    """Row 68: returns (final frame with F, list of fitted trees).

    The rows are laid out by time once, their features as bins; a level of a
    tree is one pass over the resident blocks, and no step shuffles or writes.
    Every row takes part in every tree."""
    from pyspark.ml.feature import VectorAssembler

    xc = [f"x{k}" for k in range(len(features))]
    base = df.select(F.col(id_col).alias("id"), F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                     *[F.col(f"`{c}`").cast("double").alias(x) for x, c in zip(xc, features, strict=True)])
    base = base.checkpoint(eager=True)
    missing = lambda x: F.count(F.when(F.col(x).isNull() | F.isnan(x), 1))
    seen = base.agg(F.count("time").alias("n"), F.count(F.when(F.col("event").isNull() & F.col("time").isNotNull(), 1)).alias("events"),
                    *[missing(x).alias(x) for x in xc]).first()
    if any(seen[x] for x in xc):
        raise ValueError("a feature is null or NaN")
    if seen["events"]:
        raise ValueError("an event is null")
    if not seen["n"]:
        raise ValueError("no rows to fit trees to")
    base = base.where("time IS NOT NULL")
    rows = _BoostRows(base, xc, seen["n"], _thresholds(base, xc, seen["n"], max_bins), learning_rate)
    models, weights = [], rows.n
    for _ in range(n_estimators):
        tree, weights = _grow(rows, weights, max_depth, min_instances)
        models.append(tree)
        rows.add(tree)
    rows.close()
    fitted = [(t.feature, t.threshold, t.value) for t in models]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(_scores(np.zeros(len(columns[0])), fitted, [c.to_numpy() for c in columns], learning_rate))

    d = VectorAssembler(inputCols=xc, outputCol="features", handleInvalid="error").transform(base.withColumn("F", score(*xc)))
    return d.select("id", "time", "event", "features", "F"), models


def tree_importances(models) -> np.ndarray:
    """Row 69: feature importances averaged over the trees."""
    imps = [m.featureImportances.toArray() for m in models]
    return np.mean(imps, axis=0) if imps else np.array([])
