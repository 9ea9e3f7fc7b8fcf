import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import metrics, survival
from hazardflow.operators.kernels import bucket_fold


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_batches_and_odd_keys(spark, descending, monkeypatch):
    rng = np.random.default_rng(4)
    keys = [float(v) for v in rng.integers(0, 30, 300)] + [None, None, float("nan"), float("nan"), -0.0]
    data = [(k, int(rng.integers(0, 4)), float(rng.integers(1, 9))) for k in keys]
    place = lambda k: (-1, 0) if k is None else (1, 0) if k != k else (0, k)
    want = np.zeros(4)
    for k in {place(k) for k in keys}:
        own = sum(v * np.eye(4)[b] for x, b, v in data if place(x) == k)
        upto = sum(v * np.eye(4)[b] for x, b, v in data if (place(x) >= k if descending else place(x) <= k))
        want += own * upto
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # keys go on in the next batch
    try:
        for exclusive in (False, True):
            got = bucket_fold(spark.createDataFrame(data, "k double, b int, v double"), "k", "b", {"v": F.col("v")}, "v", 4,
                              lambda own, run: (own["v"] * run).sum(axis=0), 4, descending, exclusive, parts=5)
            less = sum((sum(v * np.eye(4)[b] for x, b, v in data if place(x) == k)) ** 2 for k in {place(k) for k in keys})
            assert np.allclose(got, want - (less if exclusive else 0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_plans_stay_narrow(spark, monkeypatch):
    """No frame of the scan has a column for every cut point."""
    widths = []
    for module in (survival, metrics):
        monkeypatch.setattr(module, "bucket_fold", lambda df, *a, **k: widths.append(len(df.columns)) or bucket_fold(df, *a, **k))
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(t), int(e), float(x)) for t, e, x in zip(
        rng.integers(1, 40, 200), rng.random(200) < 0.7, rng.normal(size=200), strict=True)], "time double, event int, x double")
    got = survival.cutpoint_scan(df, "x", cuts=[-0.5, 0.0, 0.7]).collect()
    assert [r["k"] for r in got] == [0, 1, 2] and metrics.dynamic_auc(df, "x", [5.0, 20.0])[0].count() == 2
    assert widths == [3, 3]
