"""Cross-fold aggregation.

Per-fold outputs are long tables: coefficients ``(fold, feature, coef)``,
risk scores ``(fold, <id>, time, event, risk_score)``, dynamic AUC
``(fold, time, auc)``.  Wide pivots are for display only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coef_summary(coefs: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Row 93: outer union of fold coefficients (a feature absent from a
    fold counts 0); mean, sd (ddof 1), median of coef and exp(coef), and
    exp(coef_mean).  The scaffold is features x folds, both small."""
    feats = coefs.select("feature").distinct()
    folds = coefs.select("fold").distinct() if folds is None else folds
    fold_ids = [r[0] for r in folds.collect()]  # bounded by the CV design
    scaffold = feats.select("feature", F.explode(F.array(*[F.lit(f) for f in fold_ids])).alias("fold"))
    full = scaffold.join(coefs, ["feature", "fold"], "left").fillna(0.0, subset=["coef"]) \
        .withColumn("exp_coef", F.exp("coef"))
    agg = full.groupBy("feature").agg(
        F.avg("coef").alias("coef_mean"), F.stddev_samp("coef").alias("coef_std"),
        F.percentile("coef", 0.5).alias("coef_median"),
        F.avg("exp_coef").alias("exp_coef_mean"), F.stddev_samp("exp_coef").alias("exp_coef_std"),
        F.percentile("exp_coef", 0.5).alias("exp_coef_median"))
    return agg.withColumn("exp_coef_of_mean", F.exp("coef_mean"))


def linear_predictor(coefs: dict[str, float]) -> Column:
    """Row 13: X . beta as a codegen expression."""
    out = F.lit(0.0)
    for f, b in coefs.items():
        out = out + F.col(f"`{f}`").cast("double") * F.lit(float(b))
    return out


def risk_final(detail: DataFrame, rows: DataFrame, id_col: str, mean_coefs: dict[str, float]) -> DataFrame:
    """Row 95: per sample mean and median risk over the folds that scored
    it, the score from the mean coefficients, and exp of each."""
    agg = detail.groupBy(id_col).agg(F.avg("risk_score").alias("risk_score_mean"),
                                     F.percentile("risk_score", 0.5).alias("risk_score_median"))
    base = rows.select(id_col, "time", "event", linear_predictor(mean_coefs).alias("risk_score_coefs_mean"))
    j = base.join(agg, id_col)
    return j.select(id_col, "time", "event", "risk_score_mean", "risk_score_median", "risk_score_coefs_mean",
                    F.exp("risk_score_mean").alias("exp_risk_score_mean"),
                    F.exp("risk_score_median").alias("exp_risk_score_median"),
                    F.exp("risk_score_coefs_mean").alias("exp_risk_score_coefs_mean"))


def auc_curve_summary(auc_long: DataFrame) -> DataFrame:
    """Row 97: per grid time mean, median, sd and 1.96 * sem over folds,
    NULLs (fold lacks the time) ignored."""
    a = auc_long.filter(F.col("auc").isNotNull())
    return a.groupBy("time").agg(
        F.count(F.lit(1)).alias("n"), F.avg("auc").alias("mean"),
        F.percentile("auc", 0.5).alias("median"), F.stddev_samp("auc").alias("sd"),
        (F.lit(1.96) * F.stddev_samp("auc") / F.sqrt(F.count(F.lit(1)))).alias("ci95"))


def coef_box(coefs: DataFrame, groups: DataFrame) -> DataFrame:
    """Row 98: per feature (inner join with its role group) quartiles, mean
    and number of fold coefficients outside 1.5 IQR."""
    j = coefs.join(F.broadcast(groups), "feature")
    q = j.groupBy("group", "feature").agg(
        F.percentile("coef", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("qs"),
        F.avg("coef").alias("mean"))
    q = q.select("group", "feature", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("median"),
                 F.col("qs")[2].alias("q3"), "mean")
    out = j.join(q, ["group", "feature"])
    iqr = F.col("q3") - F.col("q1")
    outlier = (F.col("coef") < F.col("q1") - 1.5 * iqr) | (F.col("coef") > F.col("q3") + 1.5 * iqr)
    return out.groupBy("group", "feature", "q1", "median", "q3", "mean").agg(
        F.sum(outlier.cast("int")).alias("n_outliers"))


def pivot_display(long: DataFrame, index: str, column: str, value: str) -> DataFrame:
    """Row 96: wide view on demand (folds as columns)."""
    return long.groupBy(index).pivot(column).agg(F.first(value))


def roc_table(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    """Row 100: classification ROC over the distinct score thresholds
    (descending): cumulative true/false positives, tpr, fpr, accuracy.
    Rows collapse to distinct scores first; the running sums use the
    distributed ordered sum."""
    from .kernels import cumulative
    pos = (F.col(label) > 0).cast("double")
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(pos).alias("p"),
                                                          F.sum(1.0 - pos).alias("q"))
    tot = per.agg(F.sum("p").alias("P"), F.sum("q").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    cum = cumulative(per, ["threshold"], {"tp": "p", "fp": "q"}, descending=True, **kw)
    return cum.select("threshold", "tp", "fp", (F.col("tp") / F.lit(P)).alias("tpr"),
                      (F.col("fp") / F.lit(N)).alias("fpr"),
                      ((F.col("tp") + F.lit(N) - F.col("fp")) / F.lit(P + N)).alias("accuracy"))


def roc_auc(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    """Row 100: (positives, negatives, auc), the area under the curve of ``roc_table`` by trapezoids.

    Rows of equal score make one step, so a tied pair counts one half; auc is
    null if a class is absent."""
    from .kernels import cumulative
    pos = (F.col(label) > 0).cast("double")
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(pos).alias("p"), F.sum(1.0 - pos).alias("q"))
    cum = cumulative(per, ["threshold"], {"above": "p"}, descending=True, exclusive=True, **kw)
    return cum.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("positives"),
                   F.coalesce(F.sum("q"), F.lit(0.0)).alias("negatives"),
                   F.sum(F.col("q") * (F.col("above") + F.col("p") / 2)).alias("won")).select(
        "positives", "negatives",
        F.when(F.col("positives") * F.col("negatives") > 0,
               F.col("won") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def risk_strip(scores: DataFrame, id_col: str, time: str = "time", event: str = "event", **kw) -> DataFrame:
    """Row 99: ``scores`` with a gapless ``position`` from 0 by (time, event, id).

    The position is an ordered sum over range partitions, so neither a hot
    time nor the whole strip meets in one task; nulls come first.  Store the
    strip with ``write_table(..., order_by=["position"])``."""
    ran = cumulative_position(scores, [time, event, id_col], **kw)
    return ran.select("position", *[F.col(f"`{c}`") for c in scores.columns])


def cumulative_position(df: DataFrame, order_by: list[str], name: str = "position", **kw) -> DataFrame:
    """``df`` with the number of rows before each one in the order of ``order_by``."""
    from .kernels import cumulative
    return cumulative(df, order_by, {name: F.lit(1)}, exclusive=True, **kw).withColumn(name, F.col(name).cast("long"))
