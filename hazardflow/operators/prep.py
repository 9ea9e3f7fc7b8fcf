"""Missing values, imputation and scaling.

Fitting computes a handful of numbers per feature with Spark aggregates;
the fitted object turns into Column expressions, so the same transform
applies to the training table, a prediction table or a streaming frame
(defect B18: the fitted statistics are kept, never re-fitted at predict).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import cumulative


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def missing(c: str) -> Column:
    """NULL and NaN are both missing."""
    return q(c).isNull() | F.isnan(q(c))


def clean(c: str) -> Column:
    return F.when(~missing(c), q(c).cast("double"))


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Linear-interpolated quantiles per column, exact at every size.

    Rows collapse to (column, value, count); a distributed running count
    gives each value its range of positions, and only the values at the
    positions asked for (at most two per column and probability) are
    collected.  Missing values are left out; an empty column gives None."""
    if not cols:
        return {}
    named = df.select(*[clean(c).alias(f"c{i}") for i, c in enumerate(cols)])
    long = named.unpivot([], [f"c{i}" for i in range(len(cols))], "feature", "value").filter("value IS NOT NULL")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = cumulative(counts, ["value"], {"upto": "n"}, segment=["feature"]).persist()
    sizes = {r["feature"]: int(r["upto"]) for r in upto.groupBy("feature").agg(F.max("upto").alias("upto")).collect()}
    at = {f: [p * (n - 1) for p in probs] for f, n in sizes.items()}
    wanted = {f: np.unique([x for v in vs for x in (math.floor(v), math.ceil(v))]) for f, vs in at.items()}

    def find(frames):
        for pdf in frames:
            for feature, part in pdf.groupby("feature"):
                want = wanted[feature]
                first = np.searchsorted(want, (part["upto"] - part["n"]).to_numpy(), "left")
                last = np.searchsorted(want, part["upto"].to_numpy(), "left")
                hit = np.flatnonzero(last > first)
                for k in hit:
                    yield pd.DataFrame({"feature": feature, "position": want[first[k]:last[k]].astype("int64"),
                                        "value": part["value"].iloc[k]})

    found = {(r["feature"], r["position"]): r["value"]
             for r in upto.mapInPandas(find, "feature string, position long, value double").collect()}
    upto.unpersist()
    out = {}
    for i, c in enumerate(cols):
        f = f"c{i}"
        if f not in sizes:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for v in at[f]:
            lo, hi = found[(f, math.floor(v))], found[(f, math.ceil(v))]
            out[c].append(float(lo if lo == hi else lo + (hi - lo) * (v - math.floor(v))))
    return out


# ---------------------------------------------------------------------------
# rows 8-11: missing-value profile and sparse rows/columns


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row 8 input: per column, n, non-missing count and missing share."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")] + [F.count(clean(c)).alias(f"c{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("non_missing"))
                                for i, c in enumerate(cols)]))
    return wide.select(F.col("__n").alias("n"), stack.alias("s")).select(
        F.col("s.feature").alias("feature"), "n", F.col("s.non_missing").alias("non_missing"),
        (F.lit(1.0) - F.col("s.non_missing") / F.col("n")).alias("missing_share"))


def keep_columns(df: DataFrame, cols: list[str], miss_col: float = 0.8) -> list[str]:
    """Row 8: keep columns with >= round(n * MissCol) non-missing values."""
    prof = missing_profile(df, cols).collect()  # one row per column (metadata)
    keep = set()
    for r in prof:
        if r["non_missing"] >= round(r["n"] * miss_col):
            keep.add(r["feature"])
    return [c for c in cols if c in keep]


def row_filter(cols: list[str], miss_row: float = 0.8) -> Column:
    """Row 9: keep rows with >= round(p * MissRow) non-missing values (after row 8)."""
    thresh = round(len(cols) * miss_row)
    nn = sum((~missing(c)).cast("int") for c in cols) if cols else F.lit(0)
    return nn >= F.lit(thresh)


def mode_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows 10/33: share of the most frequent non-missing value per column
    (denominator includes missing rows) and the smallest modal value.

    Unpivot -> count per (feature, value) with partial aggregation ->
    max per feature.  No per-feature group is materialised."""
    long = df.select(*[clean(c).alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    n = df.count()
    cnt = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").count()
    best = cnt.groupBy("feature").agg(
        F.max(F.struct("count", (-F.col("value")).alias("negv"))).alias("m"))
    return best.select("feature", F.col("m.count").alias("mode_count"),
                       (-F.col("m.negv")).alias("mode_value"),
                       (F.col("m.count") / F.lit(float(n))).alias("mode_share"))


def drop_near_constant(df: DataFrame, cols: list[str], mtfreq: float = 0.97) -> list[str]:
    """Row 10 (defect B1 fixed: the column is dropped)."""
    shares = {r["feature"]: r["mode_share"] for r in mode_share(df, cols).collect()}
    return [c for c in cols if shares.get(c, 0.0) <= mtfreq]


def removed_samples(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row 11: samples removed by the row filter (anti join on the id)."""
    return before.select(key).join(after.select(key), key, "left_anti")


# ---------------------------------------------------------------------------
# rows 14-16: imputation


@dataclass
class Imputer:
    strategy: str = "mean"          # mean | median | most_frequent | constant
    fill_value: float = 0.0
    stats: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, cols: list[str]) -> "Imputer":
        if self.strategy == "mean":
            row = df.agg(*[F.avg(clean(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
            self.stats = {c: row[f"a{i}"] for i, c in enumerate(cols)}
        elif self.strategy == "median":
            qs = quantiles(df, cols, [0.5])
            self.stats = {c: v[0] for c, v in qs.items()}
        elif self.strategy == "most_frequent":
            ms = {r["feature"]: r["mode_value"] for r in mode_share(df, cols).collect()}
            self.stats = {c: ms.get(c) for c in cols}
        elif self.strategy == "constant":
            self.stats = {c: float(self.fill_value) for c in cols}
        else:
            raise ValueError(self.strategy)
        return self

    def columns(self) -> dict[str, Column]:
        return {c: F.coalesce(clean(c), F.lit(v).cast("double")) for c, v in self.stats.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        return with_columns(df, self.columns())


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.withColumns(exprs)


# ---------------------------------------------------------------------------
# rows 17-27: scalers


class Scaler:
    code = "none"
    #: True if the stage takes a column as it is, False if as a number
    raw = False

    def fit(self, df: DataFrame, cols: list[str]) -> "Scaler":
        self.cols = list(cols)
        return self

    def columns(self, src: dict[str, Column]) -> dict[str, Column]:
        return dict(src)

    def state(self) -> dict:
        return {"code": self.code, **{k: v for k, v in self.__dict__.items() if k != "cols"}}


class Standard(Scaler):
    """Row 17: (x - mean) / population sd; sd 0 -> divide by 1."""
    code = "S"

    def fit(self, df, cols):
        super().fit(df, cols)
        row = df.agg(*[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(clean(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        self.mean = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        self.scale = {c: (row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
        return self

    def columns(self, src):
        return {c: (e - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c, e in src.items()}


class Robust(Scaler):
    """Row 18: (x - median) / (q_hi - q_lo); range 0 -> 1."""
    code = "R"

    def __init__(self, lo: float = 10.0, hi: float = 90.0):
        self.lo, self.hi = lo, hi

    def fit(self, df, cols):
        super().fit(df, cols)
        qs = quantiles(df, cols, [self.lo / 100.0, 0.5, self.hi / 100.0])
        self.center = {c: qs[c][1] for c in cols}
        self.scale = {c: ((qs[c][2] - qs[c][0]) or 1.0) for c in cols}
        return self

    def columns(self, src):
        return {c: (e - F.lit(self.center[c])) / F.lit(self.scale[c]) for c, e in src.items()}


class MinMax(Scaler):
    """Row 19: to [0, 1]; constant column -> x - min."""
    code = "M"

    def fit(self, df, cols):
        super().fit(df, cols)
        row = df.agg(*[F.min(clean(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.max(clean(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        self.lo = {c: row[f"a{i}"] for i, c in enumerate(cols)}
        self.rng = {c: ((row[f"b{i}"] - row[f"a{i}"]) or 1.0) for i, c in enumerate(cols)}
        return self

    def columns(self, src):
        return {c: (e - F.lit(self.lo[c])) / F.lit(self.rng[c]) for c, e in src.items()}


class MaxAbs(Scaler):
    """Row 20: x / max|x|."""
    code = "MA"

    def fit(self, df, cols):
        super().fit(df, cols)
        row = df.agg(*[F.max(F.abs(clean(c))).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        self.scale = {c: (row[f"a{i}"] or 1.0) for i, c in enumerate(cols)}
        return self

    def columns(self, src):
        return {c: e / F.lit(self.scale[c]) for c, e in src.items()}


class RowNormalizer(Scaler):
    """Row 23: each row to unit L2 norm (zero rows unchanged)."""
    code = "N"

    def columns(self, src):
        norm = F.sqrt(sum(e * e for e in src.values()))
        return {c: F.when(norm > 0, e / norm).otherwise(e) for c, e in src.items()}


class Ordinal(Scaler):
    """Row 21: category -> index in sorted order (dense rank of the value).

    Takes the column as it is, text included.  The levels become literals of
    the plan, so there may be ``max_levels`` of them; more raise."""
    code = "OE"
    raw = True
    max_levels = 10_000

    def fit(self, df, cols):
        super().fit(df, cols)
        self.levels = {}
        for c in cols:
            found = df.select(q(c)).filter(q(c).isNotNull()).distinct().limit(self.max_levels + 1).collect()
            if len(found) > self.max_levels:
                raise ValueError(f"column {c} has more than {self.max_levels} categories")
            vals = sorted(r[0] for r in found)
            self.levels[c] = vals
        return self

    def columns(self, src):
        out = {}
        for c, e in src.items():
            m = F.create_map(*[x for i, v in enumerate(self.levels[c]) for x in (F.lit(v), F.lit(float(i)))])
            out[c] = m[e]
        return out


class OneHot(Ordinal):
    """Row 22: category -> one indicator column per level (no level dropped)."""
    code = "OH"

    def columns(self, src):
        out = {}
        for c, e in src.items():
            for v in self.levels[c]:
                out[f"{c}_{v}"] = (e == F.lit(v)).cast("double")
        return out


class Quantile(Scaler):
    """Row 24: value -> uniform [0, 1] through an n-quantile table with
    linear interpolation, averaging the forward and reversed interpolation
    so repeated quantiles map to the middle of their flat run."""
    code = "QT"

    def __init__(self, n_quantiles: int = 1000):
        self.n_quantiles = n_quantiles

    def fit(self, df, cols):
        super().fit(df, cols)
        n = df.count()
        k = min(self.n_quantiles, n)
        self.refs = [float(x) for x in np.linspace(0, 1, k)]
        self.table = quantiles(df, cols, self.refs)
        return self

    def columns(self, src):
        return {c: _quantile_udf(self.table[c], self.refs)(e) for c, e in src.items()}


def _quantile_udf(knots: list, refs: list):
    """Arrow-batched interpolation through a bounded knot table (at most
    n_quantiles numbers captured in the closure)."""
    from pyspark.sql.functions import pandas_udf

    qs = np.asarray(knots, dtype=float)
    rs = np.asarray(refs, dtype=float)

    @pandas_udf("double")
    def interp(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        out = 0.5 * (np.interp(v, qs, rs) - np.interp(-v, -qs[::-1], -rs[::-1]))
        return pd.Series(np.where(np.isnan(v), np.nan, out))

    return interp


def _yj(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    if abs(lam - 2.0) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(pos, a).otherwise(b)


def _merged(a: tuple, b: tuple) -> tuple:
    """(count, mean, squared deviations) of two groups together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


class Power(Scaler):
    """Row 25: Yeo-Johnson with lambda by maximum likelihood, then
    standardised.  Each search pass evaluates a batch of lambdas for every
    feature in one aggregation (variance of psi, sum of sign*log1p|x|); the
    bracket moves on while its best is at an end, then shrinks to ``tol``."""
    code = "PT"

    def __init__(self, lo: float = -2.0, hi: float = 2.0, per_pass: int = 17, tol: float = 1e-8):
        self.lo, self.hi, self.per_pass, self.tol = lo, hi, per_pass, tol

    def _llf(self, df, cols, lams: dict[str, list[float]]):
        """Profile log-likelihood of every lambda: each task folds its rows into
        counts, means and squared deviations; those are merged here (one row a
        task, column and lambda)."""
        grid = [np.array(lams[c]) for c in cols]

        def fold(frames):
            state = {}
            for pdf in frames:
                for i in range(len(cols)):
                    x = pdf[f"c{i}"].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    if not len(x):
                        continue
                    size, sign = np.log1p(np.abs(x)), x >= 0
                    for j, lam in enumerate(grid[i]):
                        rate = np.where(sign, lam, 2.0 - lam)
                        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                            # ((1 + |x|) ** rate - 1) / rate, and its limit at 0
                            y = np.where(np.abs(rate) < 1e-12, size, np.expm1(rate * size) / rate)
                            y = np.where(sign, y, -y)
                            new = (float(len(x)), float(y.mean()), float(((y - y.mean()) ** 2).sum()))
                        sl = float((np.where(sign, 1.0, -1.0) * size).sum())
                        old = state.get((i, j))
                        state[i, j] = (*new, sl) if old is None else (*_merged(old[:3], new), old[3] + sl)
            if state:
                yield pd.DataFrame([(i, j, *v) for (i, j), v in state.items()], columns=["i", "j", "n", "m", "d", "l"])

        parts = df.select(*[clean(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(
            fold, "i int, j int, n double, m double, d double, l double").collect()
        total = {}
        for r in parts:
            key, new = (r["i"], r["j"]), (r["n"], r["m"], r["d"])
            old = total.get(key)
            total[key] = (*new, r["l"]) if old is None else (*_merged(old[:3], new), old[3] + r["l"])
        out = {}
        for i, c in enumerate(cols):
            vals = []
            for j, lam in enumerate(lams[c]):
                n, _, d, sl = total.get((i, j), (0.0, 0.0, 0.0, 0.0))
                ok = n and 0 < d < math.inf
                vals.append(-n / 2.0 * math.log(d / n) + (lam - 1.0) * sl if ok else -math.inf)
            out[c] = vals
        return out

    def fit(self, df, cols):
        super().fit(df, cols)
        bounds = {c: (self.lo, self.hi) for c in cols}
        best = {}
        todo = list(cols)
        while todo:
            lams = {c: list(np.linspace(bounds[c][0], bounds[c][1], self.per_pass)) for c in todo}
            ll = self._llf(df, todo, lams)
            for c in list(todo):
                j = int(np.argmax(ll[c]))
                best[c] = lams[c][j]
                width = bounds[c][1] - bounds[c][0]
                step = width / (self.per_pass - 1)
                flat = not np.isfinite(ll[c][j]) or max(ll[c]) - min(ll[c]) <= 1e-13 * abs(ll[c][j])
                if flat or 2 * step < self.tol or abs(best[c]) > 1e6:
                    todo.remove(c)  # found, or a column that no lambda tells apart
                elif j in (0, self.per_pass - 1) and width >= self.hi - self.lo:
                    # the best is at an end of a wide bracket: move on past it
                    bounds[c] = (best[c] - width, best[c] + width)
                else:
                    bounds[c] = (best[c] - step, best[c] + step)
        self.lmbda = best
        row = df.agg(*[F.avg(_yj(clean(c), best[c])).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(_yj(clean(c), best[c])).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        self.mean = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        self.scale = {c: (row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
        return self

    def columns(self, src):
        return {c: (_yj(e, self.lmbda[c]) - F.lit(self.mean[c])) / F.lit(self.scale[c])
                for c, e in src.items()}


SCALERS = {"S": Standard, "R": Robust, "M": MinMax, "MA": MaxAbs, "OE": Ordinal, "OH": OneHot,
           "N": RowNormalizer, "QT": Quantile, "PT": Power, "none": Scaler}


class ScalerChain:
    """Row 27: scalers applied in order (``-s S M``); each stage is fitted
    on the output of the previous one."""

    def __init__(self, codes: list[str], **kw):
        self.codes = list(codes)
        self.stages: list[Scaler] = []
        self.kw = kw

    def fit(self, df: DataFrame, cols: list[str]) -> "ScalerChain":
        cur = df
        names = list(cols)
        self.stages = []
        for code in self.codes:
            st = SCALERS[code](**self.kw.get(code, {})) if code in self.kw else SCALERS[code]()
            st.fit(cur, names)
            exprs = st.columns({c: q(c) if st.raw else clean(c) for c in names})
            cur = cur.select(*[F.col(f"`{c}`") for c in cur.columns if c not in exprs],
                             *[e.alias(c) for c, e in exprs.items()])
            names = list(exprs)
            self.stages.append(st)
        self.out_cols = names
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        for st in self.stages:
            exprs = st.columns({c: q(c) if st.raw else clean(c) for c in st.cols})
            keep = [F.col(f"`{c}`") for c in cur.columns if c not in st.cols and c not in exprs]
            cur = cur.select(*keep, *[e.alias(c) for c, e in exprs.items()])
        return cur

    def to_json(self) -> str:
        return json.dumps([st.state() for st in self.stages], default=float)
