"""Registered queries: the two lifecycles end to end (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from ..sources import views as V
from . import pipeline
from .registry import query

FEATURES = ["value", "k", "hour", "is_click", "is_view", "is_signup"]


def _split(spark, sf):
    ev = V.surv_events(spark, sf, with_nulls=True)
    ho = splits.systematic_holdout(ev, "event_id", "time", "event", 0.3)
    j = ev.join(ho, "event_id").persist()
    return j.filter(~F.col("is_test")).drop("is_test"), j.filter("is_test").drop("is_test")


@query("auto_pipeline")
def auto_pipeline(spark, sf):
    """Lifecycle (a): impute + scale, univariate Cox screen, SSA outer CV of
    CoxPH with a grid search in each fold, per-sample final risk table."""
    train, _ = _split(spark, sf)
    res = pipeline.auto(train, FEATURES, "event_id")
    return res.risk_final


@query("predict_pipeline")
def predict_pipeline(spark, sf):
    """Lifecycle (b): stored transforms and fold models applied to the
    systematic hold-out; mean / median risk per sample."""
    train, hold = _split(spark, sf)
    res = pipeline.auto(train, FEATURES, "event_id")
    _, agg, _ = pipeline.predict(res.bundle, hold, "event_id")
    return agg
