"""Evaluation: Harrell C, Uno C, cumulative/dynamic AUC.

Concordance is computed exactly with the S2 dominance kernel: rows get a
global rank by (time asc, events before censored, score desc); then every
comparable pair (i event, j later in that order) is counted by score
comparison, and the event-event pairs at the same time (not comparable) are
removed from per-(time, score) counts.  Ties in score count one half.
Score ties are exact equality (no tolerance).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import bucket_fold, cumulative, dense_rank_global, dominance
from .prep import quantiles
from .survival import kaplan_meier, step_lookup


def _concordance(df: DataFrame, time: str, event: str, score: Column | str,
                 weight: Column | None, **kw) -> dict:
    s = F.col(score) if isinstance(score, str) else score
    e = (F.col(event) > 0)
    w = F.lit(1.0) if weight is None else weight
    base = df.select(F.col(time).cast("double").alias("t"), e.alias("e"),
                     s.cast("double").alias("s"),
                     F.when(e, w).otherwise(0.0).cast("double").alias("a"),
                     F.lit(1.0).alias("b"))
    base = base.persist()
    try:
        ranked, n = dense_rank_global(
            base, ["t", F.when(F.col("e"), 0).otherwise(1), F.col("s") * -1.0], name="r", parts=kw.get("parts"))
        ranked = ranked.persist()
        less, eq = dominance(ranked, "r", "s", "a", "b", n_rows=n, **kw)
        tot = ranked.agg(F.sum(F.col("a") * (F.lit(n - 1) - F.col("r"))).alias("pairs")).first()
        # event-event pairs at the same time: in rank order, not comparable.
        ev = ranked.filter("e")
        ts = ev.groupBy("t", "s").agg(F.count(F.lit(1)).cast("double").alias("m"),
                                      F.max("a").alias("a"))
        per_t = ts.groupBy("t").agg(
            F.sum("m").alias("m"), F.max("a").alias("a"),
            F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("eqp"))
        ex = per_t.agg(
            F.sum(F.col("a") * (F.col("m") * (F.col("m") - 1) / 2 - F.col("eqp"))).alias("xl"),
            F.sum(F.col("a") * F.col("eqp")).alias("xe"),
            F.sum(F.col("a") * F.col("m") * (F.col("m") - 1) / 2).alias("xp")).first()
        ranked.unpersist()
    finally:
        base.unpersist()
    xl, xe, xp = (float(ex["xl"] or 0), float(ex["xe"] or 0), float(ex["xp"] or 0))
    concordant = less - xl
    tied = eq - xe
    comparable = float(tot["pairs"] or 0) - xp
    cindex = (concordant + 0.5 * tied) / comparable if comparable > 0 else float("nan")
    return {"cindex": cindex, "concordant": concordant, "tied_risk": tied,
            "discordant": comparable - concordant - tied, "comparable": comparable}


def harrell_c(df: DataFrame, score: Column | str, time: str = "time", event: str = "event",
              **kw) -> dict:
    """Row 73: Harrell's C (pairs: i event, t_j > t_i or t_j = t_i with j
    censored; concordant when score_i > score_j, ties 1/2)."""
    return _concordance(df, time, event, score, None, **kw)


def censoring_weights(train: DataFrame, test: DataFrame, time: str = "time", event: str = "event",
                      **kw) -> DataFrame:
    """G(t) = Kaplan-Meier of the censoring distribution fitted on ``train``,
    evaluated (right-continuous) at every distinct time of ``test``.
    Returns (time, G)."""
    g = kaplan_meier(train, time, event, reverse=True, **kw).select("time", "survival")
    return step_lookup(g, "survival", test.select(F.col(time).alias("time")), **kw) \
        .withColumnRenamed("survival", "G")


def uno_c(test: DataFrame, score: Column | str, train: DataFrame | None = None,
          time: str = "time", event: str = "event", tau: float | None = None,
          pooled: DataFrame | None = None, **kw) -> dict:
    """Row 74: Uno's C, event weights 1/G(t_i)^2, optional truncation tau.

    Where G is zero at an event time it raises, or takes the censoring
    distribution of ``pooled`` (all outcomes), truncated at the last time of
    the test rows' grid."""
    train = test if train is None else train
    g = censoring_weights(train, test, time, event, **kw)
    s = F.col(score) if isinstance(score, str) else score
    t = test.select(F.col(time).alias("time"), F.col(event).alias("event"), s.alias("_s"))
    t = t.join(g, "time", "left")
    e = F.col("event") > 0
    bad = t.filter(e & (F.col("G") <= 0) & (F.lit(True) if tau is None else F.col("time") < tau))
    if not bad.isEmpty():
        if pooled is None:
            raise ValueError("censoring survival function is zero at one or more time points")
        return uno_c(test, score, pooled, time, event, time_grid(test, time)[-1], **kw)
    w = F.try_divide(F.lit(1.0), F.col("G") * F.col("G"))
    if tau is not None:
        w = F.when(F.col("time") < tau, w).otherwise(0.0)
    return _concordance(t, "time", "event", "_s", w, **kw)


def time_grid(df: DataFrame, time: str = "time", lo: float = 5.0, hi: float = 95.0,
              num: int = 99) -> list:
    """Unique percentiles of the times at ``linspace(lo, hi, num)``.

    Grid times at or beyond the largest follow-up time have no controls and
    are left out (the reference's metric rejects such grids outright)."""
    qs = [float(q) / 100.0 for q in np.linspace(lo, hi, num)]
    found = quantiles(df, [time], [*qs, 1.0])[time]
    return sorted({v for v in found[:-1] if v is not None and v < found[-1]})


def dynamic_auc(test: DataFrame, score: Column | str, times: list, train: DataFrame | None = None,
                time: str = "time", event: str = "event", pooled: DataFrame | None = None,
                **kw) -> tuple[DataFrame, DataFrame]:
    """Row 75: cumulative/dynamic AUC(t) for each t in ``times``.

    Cases: event with time <= t, weight 1/G(time); controls: time > t.
    AUC(t) = sum_case w_i (#controls with lower score + 1/2 #equal)
             / (sum_case w_i * #controls).
    Returns (per-time table [k, time, auc], one-row mean table [mean_auc]),
    mean = sum_k AUC_k (S(t_{k-1}) - S(t_k)) / (1 - S(t_K)), S = KM of test.
    Where G is zero for a case it raises, or takes the censoring distribution
    of ``pooled`` (all outcomes).
    """
    train = test if train is None else train
    g = censoring_weights(train, test, time, event, **kw)
    s = F.col(score) if isinstance(score, str) else score
    t = test.select(F.col(time).alias("time"), (F.col(event) > 0).alias("e"), s.cast("double").alias("s"))
    t = t.join(g, "time", "left")
    late = F.col("time") <= (float(times[-1]) if times else float("-inf"))
    if not t.filter(F.col("e") & late & (F.coalesce("G", F.lit(0.0)) <= 0)).isEmpty():
        if pooled is None:
            raise ValueError("censoring survival function is zero at one or more time points")
        return dynamic_auc(test, score, times, pooled, time, event, **kw)
    taus = F.array(*[F.lit(float(x)) for x in times])
    K = len(times)
    pos = F.size(F.filter(taus, lambda x: x < F.col("time")))  # grid times before this row's time
    # Row with bucket b = pos: a case for every k >= b (if an event), a
    # control for every k < b.  Rows collapse to distinct scores and buckets
    # with case weights W_b and control counts C_b; one ordered sum over the
    # score gives H_b = controls with a smaller score.
    wv = F.when(F.col("e"), F.try_divide(F.lit(1.0), F.col("G"))).otherwise(0.0)

    def fold(own, H):
        wcum = np.cumsum(own["W"], axis=1)[:, :K]             # cases at k: buckets <= k
        hsuf = np.cumsum(H[:, ::-1], axis=1)[:, ::-1][:, 1:]  # controls at k: buckets > k
        csuf = np.cumsum(own["C"][:, ::-1], axis=1)[:, ::-1][:, 1:]
        return np.concatenate([np.sum(wcum * (hsuf + 0.5 * csuf), axis=0), wcum.sum(axis=0), csuf.sum(axis=0)])

    vec = bucket_fold(t.select("s", wv.alias("w"), pos.alias("b")), "s", "b", {"W": F.col("w"), "C": F.lit(1.0)}, "C",
                      K + 1, fold, 3 * K, exclusive=True, **kw)
    num, wt, ct = vec[:K], vec[K:2 * K], vec[2 * K:]
    with np.errstate(divide="ignore", invalid="ignore"):
        aucv = np.where(wt * ct > 0, num / (wt * ct), np.nan)
    spark = test.sparkSession
    auc = spark.createDataFrame([(k, float(times[k]), None if np.isnan(aucv[k]) else float(aucv[k]))
                                 for k in range(K)], "k int, time double, auc double")  # K grid rows
    # mean over the grid, weighted by drops of the test-set KM at grid times
    km = kaplan_meier(test, time, event, **kw).select("time", "survival")
    grid = auc.select("time")
    sg = step_lookup(km, "survival", grid, **kw)
    j = auc.join(sg, "time")
    # S(t_{k-1}) via a bounded window over the K grid rows
    from pyspark.sql import Window
    wk = Window.orderBy("k")
    j = j.withColumn("prev", F.coalesce(F.lag("survival").over(wk), F.lit(1.0)))
    mean = j.agg((F.sum(F.col("auc") * (F.col("prev") - F.col("survival")))
                  / (F.lit(1.0) - F.min_by("survival", F.col("k") * -1))).alias("mean_auc")) \
        if K > 1 else j.select(F.col("auc").alias("mean_auc"))
    return auc, mean


def harrell_c_by_group(df: DataFrame, group: str, score: Column | str, time: str = "time",
                       event: str = "event", **kw):
    """Harrell's C for every value of ``group`` in one set of passes
    (the batched scorer of grid search / RFECV / SFS).  Returns pandas
    (group, cindex, comparable)."""
    from .kernels import dominance_grouped
    s = F.col(score) if isinstance(score, str) else score
    e = F.col(event) > 0
    base = df.select(F.col(group).alias("g"), F.col(time).cast("double").alias("t"), e.alias("e"),
                     s.cast("double").alias("s"), F.when(e, 1.0).otherwise(0.0).alias("a"),
                     F.lit(1.0).alias("b")).persist()
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).persist()
    max_rows = int(sizes.agg(F.max("n")).first()[0] or 0)
    tmp = base.withColumn("_o1", F.when(F.col("e"), 0).otherwise(1)).withColumn("_o2", F.col("s") * -1.0)
    ranked = cumulative(tmp, ["t", "_o1", "_o2"], {"r": F.lit(1.0)}, segment=["g"], exclusive=True,
                        parts=kw.get("parts")) \
        .withColumn("r", F.col("r").cast("long")).persist()
    dom = dominance_grouped(ranked, "g", "r", "s", "a", "b", max_rows=max_rows, **kw)
    tot = ranked.join(sizes, "g").groupBy("g").agg(
        F.sum(F.col("a") * (F.col("n") - 1 - F.col("r"))).alias("pairs"))
    ts = ranked.filter("e").groupBy("g", "t", "s").agg(F.count(F.lit(1)).cast("double").alias("m"))
    per_t = ts.groupBy("g", "t").agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("eqp"))
    ex = per_t.groupBy("g").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2 - F.col("eqp")).alias("xl"),
                                F.sum("eqp").alias("xe"))
    res = tot.join(dom, "g", "left").join(ex, "g", "left").fillna(0.0).toPandas()
    ranked.unpersist()
    sizes.unpersist()
    base.unpersist()
    conc = res["l"] - res["xl"]
    tied = res["e"] - res["xe"]
    comp = res["pairs"] - (res["xl"] + res["xe"])
    res["cindex"] = (conc + 0.5 * tied) / comp.where(comp > 0)
    res["comparable"] = comp
    return res.rename(columns={"g": group})[[group, "cindex", "comparable"]]
