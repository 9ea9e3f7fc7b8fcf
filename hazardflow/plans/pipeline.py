"""End-to-end lifecycles: ``auto`` (prepare -> screen -> fit
with outer CV -> evaluate -> aggregate) and ``predict`` (apply the stored
transforms and fold models to a new table).

Stages pass DataFrames, not files; the model bundle is a set of small
tables (fold coefficients, fitted transform statistics) that can be written
with ``save_bundle`` and read back with ``load_bundle``.
"""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, cox, metrics, prep, splits
from ..operators.search import CrossValidation, _beta_table, _score_expr, inner_search


@dataclass
class Bundle:
    features: list
    imputer: dict
    scaler: dict           # {feature: (mean, scale)}
    coefs: pd.DataFrame    # fold, feature, coef
    train_outcomes: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Imputation then standardisation with the stored statistics (B18)."""
        cols = {}
        for c in self.features:
            v = F.coalesce(prep.clean(c), F.lit(self.imputer[c]).cast("double"))
            m, s = self.scaler[c]
            cols[c] = (v - F.lit(m)) / F.lit(s)
        keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
        return df.select(*keep, *[e.alias(c) for c, e in cols.items()])


@dataclass
class AutoResult:
    bundle: Bundle
    screen: pd.DataFrame
    fold_scores: pd.DataFrame
    coef_summary: DataFrame
    risk_detail: DataFrame
    risk_final: DataFrame


def prepare(df: DataFrame, features: list[str], miss_col: float = 0.8, miss_row: float = 0.8,
            strategy: str = "median", mtfreq: float = 0.97):
    """Rows 8-17: drop sparse columns, then sparse rows, then near-constant
    columns of the rows left; impute (fitted on the row-filtered table,
    applied to all rows: B2), standardise."""
    cols = prep.keep_columns(df, features, miss_col)
    fit_rows = df.filter(prep.row_filter(cols, miss_row))
    cols = prep.drop_near_constant(fit_rows, cols, mtfreq)
    imp = prep.Imputer(strategy).fit(fit_rows, cols)
    filled = imp.transform(df)
    sc = prep.Standard().fit(filled, cols)
    return cols, imp.stats, {c: (sc.mean[c], sc.scale[c]) for c in cols}


def auto(df: DataFrame, features: list[str], id_col: str, time: str = "time", event: str = "event",
         uni_p: float = 0.1, min_c: float = 0.5, n_splits: int = 10, test_size: float = 0.25, seed: int = 0,
         grid: dict | None = None) -> AutoResult:
    """Lifecycle (a).  Every outer fold's Cox model takes the alpha and ties
    that the search over ``grid`` finds inside the fold's training rows."""
    spark = df.sparkSession
    cols, imp, sc = prepare(df, features)
    b0 = Bundle(cols, imp, sc, pd.DataFrame(columns=["fold", "feature", "coef"]))
    data = b0.transform(df.select(id_col, time, event, *cols)).withColumnRenamed(time, "time") \
        .withColumnRenamed(event, "event").persist()
    # screen: univariate Cox, keep p <= UniP and C >= CIs (rows 46, 48)
    uni = cox.univariate_cox(data, cols, ties="efron")
    passed = cox.screen(uni, uni_p, min_c)
    if not passed:
        warnings.warn("no feature passes the univariate screen; all are kept", stacklevel=2)
    kept = passed or cols
    # outer CV: SSA splits, an inner search in each, one batched fit for all folds (rows 60, 76, 83)
    asg = splits.ssa(data, id_col, "event", n_splits, test_size, seed).persist()
    best = inner_search(data, kept, id_col, asg, grid)
    cv = CrossValidation(data, kept, id_col, asg.select(id_col, F.col("split").alias("fold"), "is_test"))
    _, fitted = cv.run([{**best[m], "fold": m} for m in sorted(best)], score=False)
    cv.close()
    betas = dict(zip(sorted(best), fitted))
    coefs = pd.DataFrame([(m, f, float(betas[m][j])) for m in sorted(betas) for j, f in enumerate(kept)],
                         columns=["fold", "feature", "coef"])
    bt = _beta_table(spark, [str(m) for m in betas], list(betas.values()), len(kept))
    test = data.join(asg.filter("is_test"), id_col).withColumn("model", F.col("split").cast("string"))
    detail = test.join(F.broadcast(bt), "model").select(
        F.col("split").alias("fold"), id_col, "time", "event",
        _score_expr(kept, [f"_b{k}" for k in range(len(kept))]).alias("risk_score")).persist()
    scores = metrics.harrell_c_by_group(detail, "fold", "risk_score")
    coefs_df = spark.createDataFrame(coefs)
    summary = aggregate.coef_summary(coefs_df)
    mean = coefs.groupby("feature")["coef"].mean().to_dict()
    final = aggregate.risk_final(detail, data, id_col, mean)
    bundle = Bundle(kept, {c: imp[c] for c in kept}, {c: sc[c] for c in kept}, coefs,
                    data.select("time", "event"), {"folds": {str(m): b for m, b in sorted(best.items())}, "screened": bool(passed)})
    return AutoResult(bundle, uni, scores, summary, detail, final)


def predict(bundle: Bundle, df: DataFrame, id_col: str, time: str | None = "time",
            event: str | None = "event") -> tuple[DataFrame, DataFrame, dict]:
    """Lifecycle (b): stored transforms, every fold model, mean/median risk;
    evaluation only when no prediction time is missing (row 12, B11)."""
    spark = df.sparkSession
    x = bundle.transform(df.select(id_col, *([time] if time else []), *([event] if event else []),
                                   *bundle.features))
    p = len(bundle.features)
    models = sorted(bundle.coefs["fold"].unique())
    betas = [bundle.coefs[bundle.coefs["fold"] == m].set_index("feature").loc[bundle.features, "coef"].to_numpy()
             for m in models]
    bt = _beta_table(spark, [str(m) for m in models], betas, p)
    fl = F.explode(F.array(*[F.lit(str(m)) for m in models])).alias("model")
    detail = x.select("*", fl).join(F.broadcast(bt), "model").select(
        F.col("model").cast("int").alias("fold"), id_col, *([time] if time else []), *([event] if event else []),
        _score_expr(bundle.features, [f"_b{k}" for k in range(p)]).alias("risk_score")).persist()
    agg = detail.groupBy(id_col).agg(F.avg("risk_score").alias("risk_score_mean"),
                                     F.percentile("risk_score", 0.5).alias("risk_score_median"))
    ev = {}
    if time and event and df.filter(prep.missing(time)).isEmpty():
        d = detail.withColumnRenamed(time, "time").withColumnRenamed(event, "event")
        ev["fold_cindex"] = metrics.harrell_c_by_group(d, "fold", "risk_score")
        scored = x.withColumnRenamed(time, "time").withColumnRenamed(event, "event").join(agg, id_col)
        ev["cindex_mean_score"] = metrics.harrell_c(scored, "risk_score_mean")["cindex"]
        outcomes = scored.select("time", "event")
        if bundle.train_outcomes is not None:
            outcomes = outcomes.unionByName(bundle.train_outcomes.select("time", "event"))
        ev["uno_c"] = metrics.uno_c(scored, "risk_score_mean", train=bundle.train_outcomes, pooled=outcomes)["cindex"]
    return detail, agg, ev


def save_bundle(bundle: Bundle, path: str) -> None:
    """Row 6: model sink (small tables + JSON)."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(bundle.coefs).write.mode("overwrite").parquet(os.path.join(path, "coefs"))
    meta = {"features": bundle.features, "imputer": bundle.imputer,
            "scaler": {k: list(v) for k, v in bundle.scaler.items()}, "meta": bundle.meta}
    spark.createDataFrame([(json.dumps(meta, default=float),)], "meta string") \
        .write.mode("overwrite").parquet(os.path.join(path, "meta"))
    if bundle.train_outcomes is not None:
        bundle.train_outcomes.write.mode("overwrite").parquet(os.path.join(path, "train_outcomes"))


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Row 6: model source."""
    coefs = spark.read.parquet(os.path.join(path, "coefs")).toPandas()
    meta = json.loads(spark.read.parquet(os.path.join(path, "meta")).first()["meta"])
    to = os.path.join(path, "train_outcomes")
    try:
        tr = spark.read.parquet(to)
    except AnalysisException as ex:  # a bundle without outcomes; Spark looks at its own store
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        tr = None
    return Bundle(meta["features"], meta["imputer"], {k: tuple(v) for k, v in meta["scaler"].items()},
                  coefs, tr, meta.get("meta", {}))
