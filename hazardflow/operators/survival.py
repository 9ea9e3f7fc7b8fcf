"""Survival descriptive statistics.

All of these collapse rows to one row per distinct time first (partial
aggregation before the shuffle), then run ordered sums over the distinct
times with ``kernels.cumulative``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf
from .kernels import bucket_fold, cumulative
from .prep import quantiles


def _log_step(d: Column, r: Column) -> Column:
    return F.when(d < r, F.log(F.lit(1.0) - F.try_divide(d, r)))


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event",
                 group: str | None = None, reverse: bool = False, **kw) -> DataFrame:
    """Row 54: ``S(t) = prod_{s<=t} (1 - d_s / n_s)`` per distinct time.

    ``reverse=True`` gives the censoring distribution: censorings are the
    "events" and rows that fail at the same time leave the risk set first.
    Columns: [group], time, n_at_risk, n_event, n_censored, survival.
    """
    seg = [group] if group else []
    ev = (F.col(event) > 0).cast("double")
    per = df.groupBy(*seg, F.col(time).alias("time")).agg(
        F.sum(ev).alias("n_event"), F.count(F.lit(1)).cast("double").alias("n_rows"))
    per = per.withColumn("n_censored", F.col("n_rows") - F.col("n_event"))
    per = cumulative(per, ["time"], {"n_at_risk": "n_rows"}, segment=seg, descending=True, **kw)
    if reverse:
        d, r = F.col("n_censored"), F.col("n_at_risk") - F.col("n_event")
    else:
        d, r = F.col("n_event"), F.col("n_at_risk")
    per = per.withColumn("_lg", F.coalesce(_log_step(d, r), F.lit(0.0))) \
             .withColumn("_z", ((d >= r) & (d > 0)).cast("double"))
    per = cumulative(per, ["time"], {"_slg": "_lg", "_sz": "_z"}, segment=seg, **kw)
    surv = F.when(F.col("_sz") > 0, F.lit(0.0)).otherwise(F.exp("_slg"))
    return per.select(*seg, "time", "n_at_risk", "n_event", "n_censored", surv.alias("survival"))


def nelson_aalen(df: DataFrame, time: str = "time", event: str = "event", **kw) -> DataFrame:
    """Cumulative hazard ``H(t) = sum_{s<=t} d_s / n_s``."""
    km = kaplan_meier(df, time, event, **kw)
    km = km.withColumn("_h", F.try_divide(F.col("n_event"), F.col("n_at_risk")))
    return cumulative(km, ["time"], {"cum_hazard": "_h"}, **kw).drop("_h")


def step_lookup(table: DataFrame, value: str, at: DataFrame, at_time: str = "time",
                default: float = 1.0, **kw) -> DataFrame:
    """Right-continuous step-function lookup (value at the largest table
    time <= at_time), done as an ordered "last value" carry over the union
    of both time sets: no range join, no pair expansion."""
    t = table.select(F.col("time").alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_q"))
    q = at.select(F.col(at_time).alias("_t")).distinct() \
        .select("_t", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"))
    u = t.unionByName(q)
    # carry: count of table rows so far gives a "version" index; the value is
    # recovered by joining on that index.
    u = cumulative(u, ["_t", "_q"], {"_idx": (F.col("_q") == 0).cast("double")}, **kw)
    tv = u.filter("_q = 0").select("_idx", "_v")
    qv = u.filter("_q = 1").select(F.col("_t").alias(at_time), "_idx")
    out = qv.join(tv, "_idx", "left").select(
        at_time, F.coalesce("_v", F.lit(default)).alias(value))
    return out


def logrank(df: DataFrame, group_flag: Column | str, time: str = "time", event: str = "event",
            **kw) -> dict:
    """Row 55: two-group log-rank test; ``group_flag`` true = group 1."""
    g = F.col(group_flag) if isinstance(group_flag, str) else group_flag
    ev = (F.col(event) > 0).cast("double")
    g1 = g.cast("boolean").cast("double")
    per = df.groupBy(F.col(time).alias("time")).agg(
        F.sum(ev).alias("d"), F.sum(ev * g1).alias("d1"),
        F.count(F.lit(1)).cast("double").alias("m"), F.sum(g1).alias("m1"))
    per = cumulative(per, ["time"], {"n": "m", "n1": "m1"}, descending=True, **kw)
    row = _logrank_sums(per).first()
    return _logrank_result(row)


def _logrank_sums(per: DataFrame, keys: list | None = None) -> DataFrame:
    n, n1, d, d1 = F.col("n"), F.col("n1"), F.col("d"), F.col("d1")
    e1 = d * n1 / n
    v = F.when(n > 1, n1 * (n - n1) * d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    aggs = [F.sum(d1).alias("observed"), F.sum(e1).alias("expected"), F.sum(v).alias("variance")]
    return per.groupBy(*keys).agg(*aggs) if keys else per.agg(*aggs)


def _logrank_result(row) -> dict:
    o, e, v = float(row["observed"]), float(row["expected"]), float(row["variance"])
    stat = (o - e) ** 2 / v if v > 0 else float("nan")
    return {"observed": o, "expected": e, "variance": v, "statistic": stat,
            "p": chi2_sf(stat, 1) if v > 0 else float("nan")}


def cut_points(df: DataFrame, x: str, lo: float = 10.0, hi: float = 90.0, num: int = 99) -> list:
    """Unique percentiles of ``x`` at ``linspace(lo, hi, num)`` (exact, linear)."""
    qs = [float(q) / 100.0 for q in np.linspace(lo, hi, num)]
    return sorted({v for v in quantiles(df, [x], qs)[x] if v is not None})


def cutpoint_scan(df: DataFrame, x: str, time: str = "time", event: str = "event",
                  cuts: list | None = None, **kw) -> DataFrame:
    """Row 56: log-rank of ``x >= c`` vs ``x < c`` for every cut point ``c``.

    Bucket b = number of cut points <= x; group 1 of cut k = buckets > k.
    Rows collapse to one row per distinct time and bucket with its event and
    row counts; ordered suffix sums over time give the per-bucket numbers at
    risk, from which each task folds the per-cut observed / expected /
    variance vectors (``kernels.bucket_fold``).
    """
    cuts = cut_points(df, x) if cuts is None else cuts
    K = len(cuts)
    arr = F.array(*[F.lit(float(c)) for c in cuts])
    ev = (F.col(event) > 0).cast("double")
    b = F.size(F.filter(arr, lambda c: c <= F.col(x)))
    rows = df.filter(F.col(x).isNotNull()).select(F.col(time).alias("time"), ev.alias("e"), b.alias("b"))

    def fold(own, R):
        D = own["d"]
        d = D.sum(axis=1)[:, None]
        n = R.sum(axis=1)[:, None]
        d1 = np.cumsum(D[:, ::-1], axis=1)[:, ::-1][:, 1:]   # buckets > k
        n1 = np.cumsum(R[:, ::-1], axis=1)[:, ::-1][:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(n > 1, n1 * (n - n1) * d * (n - d) / (n * n * (n - 1)), 0.0)
        return np.concatenate([d1.sum(axis=0), (d * n1 / n).sum(axis=0), v.sum(axis=0)])

    vec = bucket_fold(rows, "time", "b", {"d": F.col("e"), "m": F.lit(1.0)}, "m", K + 1, fold, 3 * K, descending=True, **kw)
    o, e, v = vec[:K], vec[K:2 * K], vec[2 * K:]
    spark = df.sparkSession
    out = [(k, float(cuts[k]), float(o[k]), float(e[k]), float(v[k]),
            float((o[k] - e[k]) ** 2 / v[k]) if v[k] > 0 else None) for k in range(K)]
    return spark.createDataFrame(out, "k int, cut double, observed double, expected double, "
                                      "variance double, statistic double")  # one row per cut point


def baseline_hazard(df: DataFrame, lp: Column, time: str = "time", event: str = "event",
                    **kw) -> DataFrame:
    """Row 57: Breslow ``H0(t) = sum_{s<=t} d_s / sum_{risk(s)} exp(lp)``,
    ``S0 = exp(-H0)`` at every distinct time."""
    ev = (F.col(event) > 0).cast("double")
    per = df.groupBy(F.col(time).alias("time")).agg(
        F.sum(ev).alias("d"), F.sum(F.exp(lp)).alias("w"))
    per = cumulative(per, ["time"], {"risk": "w"}, descending=True, **kw)
    per = per.withColumn("_h", F.col("d") / F.col("risk"))
    per = cumulative(per, ["time"], {"cum_baseline_hazard": "_h"}, **kw)
    return per.select("time", "d", "risk", "cum_baseline_hazard",
                      F.exp(-F.col("cum_baseline_hazard")).alias("baseline_survival"))


def survival_curves(df: DataFrame, lp: Column, baseline: DataFrame, grid: list,
                    keys: list, **kw) -> DataFrame:
    """Row 58: ``S(t|x) = S0(t)^exp(lp)`` for each subject at each grid time.

    The grid (a bounded list of times) is turned into a literal array of
    baseline cumulative hazards; each subject row expands into len(grid)
    rows by ``posexplode`` (a generator, no join).
    """
    bh = baseline.select("time", "cum_baseline_hazard")
    h_at = []
    for g in grid:
        v = bh.filter(F.col("time") <= F.lit(float(g))).agg(F.max(F.struct("time", "cum_baseline_hazard"))
                                                           .alias("m")).first()["m"]
        h_at.append(0.0 if v is None else float(v["cum_baseline_hazard"]))
    harr = F.array(*[F.lit(h) for h in h_at])
    garr = F.array(*[F.lit(float(g)) for g in grid])
    s = df.select(*keys, F.exp(lp).alias("_hr"), F.posexplode(harr).alias("_i", "_h"))
    return s.select(*keys, F.element_at(garr, F.col("_i") + 1).alias("grid_time"),
                    F.exp(-F.col("_h") * F.col("_hr")).alias("survival"),
                    (F.col("_h") * F.col("_hr")).alias("cum_hazard"))
