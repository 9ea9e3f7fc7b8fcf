import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.plans import pipeline
from hazardflow.sources import tables, views
from hazardflow.streaming import score
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    ev = views.surv_events(spark, SF001, with_nulls=True).persist()
    res = pipeline.auto(ev, ["value", "k", "hour", "is_click"], "event_id", n_splits=3)
    return ev, res


def test_auto_outputs(fitted):
    ev, res = fitted
    assert res.risk_final.count() == ev.count()
    assert len(res.fold_scores) >= 3
    assert set(res.bundle.coefs["feature"]) <= {"value", "k", "hour", "is_click"}


def test_bundle_roundtrip_and_predict(spark, fitted):
    ev, res = fitted
    path = tempfile.mkdtemp(prefix="hf-bundle-")
    pipeline.save_bundle(res.bundle, path)
    b = pipeline.load_bundle(spark, path)
    _, agg1, ev1 = pipeline.predict(res.bundle, ev, "event_id")
    _, agg2, _ = pipeline.predict(b, ev, "event_id")
    a1 = agg1.orderBy("event_id").toPandas()
    a2 = agg2.orderBy("event_id").toPandas()
    assert np.allclose(a1.risk_score_mean, a2.risk_score_mean)
    assert 0 <= ev1["cindex_mean_score"] <= 1


def test_stream_scoring_equals_batch(spark, fitted):
    ev, res = fitted
    src = tempfile.mkdtemp(prefix="hf-stream-src-")
    raw = ev.select("event_id", "value", "k", "hour", "is_click")
    raw.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "part"))
    q = score.score_stream(spark, res.bundle, os.path.join(src, "part"), raw.schema, ["event_id"],
                           query_name="hf_test_scores",
                           checkpoint=tempfile.mkdtemp(prefix="hf-stream-ck-"))
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM hf_test_scores").orderBy("event_id").toPandas()
    exp = score.score_frame(res.bundle, raw, ["event_id"]).orderBy("event_id").toPandas()
    assert len(got) == len(exp)
    assert np.allclose(got.risk_score_mean, exp.risk_score_mean)


def test_tsv_scan_roles(spark):
    d = tempfile.mkdtemp(prefix="hf-tsv-")
    ev = views.surv_events(spark, SF001).limit(50).select(
        F.col("event_id").cast("string").alias("Sample"), F.col("value").alias("tumor-TA-CD66B+"),
        F.col("k"), F.col("event").alias("OS_status"), F.col("time").alias("OS_months"))
    pdf = ev.toPandas()
    path = os.path.join(d, "samples.txt")
    with open(path, "w") as fh:
        fh.write("# comment line\n")
        pdf.to_csv(fh, sep="\t", index=False)
    roles = os.path.join(d, "roles.txt")
    with open(roles, "w") as fh:
        fh.write("Variables\tGroup\tType\n#k\tclinic\tR\nk\tclinic\tR\ntumor-TA-CD66B+\ttumo\tR\n"
                 "missing_col\ttumo\tR\nOS_status\tS_1\tS\nOS_months\tS_1\tT\n")
    df = tables.scan_samples(spark, path)
    assert df.count() == 50
    r = tables.split_roles(tables.scan_roles(spark, roles))
    assert r.outcomes[0].status == "OS_status" and r.outcomes[0].time == "OS_months"
    assert tables.resolve_columns(df, r.features) == ["tumor-TA-CD66B+", "k"]
