"""Streaming scoring (SURVEY §2.11: fitted transforms and linear predictors
are row-wise, so they run unchanged on a streaming DataFrame).

``score_stream`` reads new parquet files of a sample table with
``readStream``, applies the stored imputation/standardisation and every
fold model, and emits one row per sample with the mean risk score and its
hazard ratio.  The fold models are a literal expression (folds x features
numbers), so the stream needs no join and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Bundle
from ..session import ensure_checkpoint_dir


def risk_columns(bundle: Bundle) -> dict[str, Column]:
    folds = sorted(bundle.coefs["fold"].unique())
    per_fold = []
    for f in folds:
        sub = bundle.coefs[bundle.coefs["fold"] == f].set_index("feature")["coef"]
        e = F.lit(0.0)
        for c in bundle.features:
            e = e + F.col(f"`{c}`") * F.lit(float(sub.get(c, 0.0)))
        per_fold.append(e)
    mean = sum(per_fold) / F.lit(float(len(per_fold)))
    return {"risk_score_mean": mean, "hazard_ratio_mean": F.exp(mean)}


def score_frame(bundle: Bundle, df: DataFrame, keys: list[str]) -> DataFrame:
    x = bundle.transform(df)
    cols = risk_columns(bundle)
    return x.select(*keys, *[e.alias(n) for n, e in cols.items()])


def score_stream(spark: SparkSession, bundle: Bundle, source_dir: str, schema, keys: list[str],
                 sink: str = "memory", query_name: str = "risk_scores", checkpoint: str | None = None,
                 output_dir: str | None = None):
    """Start the streaming query; returns the ``StreamingQuery``.  The
    checkpoint location defaults to the session's checkpoint folder."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = score_frame(bundle, stream, keys)
    ck = checkpoint or f"{ensure_checkpoint_dir(spark)}/stream-{query_name}"
    w = out.writeStream.outputMode("append").option("checkpointLocation", ck)
    if sink == "memory":
        return w.format("memory").queryName(query_name).start()
    return w.format("parquet").option("path", output_dir).start()
