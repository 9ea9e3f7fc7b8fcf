import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import kernels, metrics, survival
from tests import brute


def _data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 25, n).astype(float)          # heavy time ties
    e = rng.random(n) < 0.6
    s = np.round(rng.normal(size=n), 1)              # score ties
    t[0], e[0] = 30.0, True                          # keeps G > 0 at event times
    return t, e, s


@pytest.fixture(scope="module")
def sdf(spark):
    t, e, s = _data()
    pdf = pd.DataFrame({"time": t, "event": e.astype(int), "score": s})
    return spark.createDataFrame(pdf).repartition(5), (t, e, s)


@pytest.mark.parametrize("parts", [None, 30])
def test_cumulative_matches_cumsum(spark, parts):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 500).astype(float), "g": rng.integers(0, 3, 500),
                        "v": rng.random(500)})
    df = spark.createDataFrame(pdf)
    agg = df.groupBy("g", "k").agg(F.sum("v").alias("v"))
    out = kernels.cumulative(agg, ["k"], {"c": "v"}, segment=["g"], descending=True,
                             parts=parts).toPandas()
    exp = pdf.groupby(["g", "k"]).v.sum().reset_index().sort_values(["g", "k"], ascending=[True, False])
    exp["c"] = exp.groupby("g").v.cumsum()
    m = out.merge(exp, on=["g", "k"])
    assert len(m) == len(exp)
    assert np.allclose(m.c_x if "c_x" in m else m["c"], m.c_y if "c_y" in m else m["c"])


@pytest.mark.parametrize("cap", [None, 16])
def test_harrell_matches_brute(sdf, cap):
    df, (t, e, s) = sdf
    kw = {} if cap is None else {"cap": cap, "parts": 9}
    r = metrics.harrell_c(df, "score", **kw)
    assert r["cindex"] == pytest.approx(brute.harrell(t, e, s), abs=1e-12)


def test_harrell_antisymmetry(sdf):
    df, _ = sdf
    a = metrics.harrell_c(df, "score")
    b = metrics.harrell_c(df, F.col("score") * -1)
    assert a["cindex"] + b["cindex"] == pytest.approx(1.0, abs=1e-12)


def test_uno_matches_brute(sdf):
    df, (t, e, s) = sdf
    r = metrics.uno_c(df, "score")
    assert r["cindex"] == pytest.approx(brute.uno(t, e, s), abs=1e-12)
    r = metrics.uno_c(df, "score", tau=15.0)
    assert r["cindex"] == pytest.approx(brute.uno(t, e, s, tau=15.0), abs=1e-12)


def test_uno_raises_on_zero_censoring_survival(spark):
    pdf = pd.DataFrame({"time": [1.0, 2.0, 2.0, 3.0], "event": [1, 1, 0, 0], "score": [1.0, 2.0, 3.0, 4.0]})
    df = spark.createDataFrame(pdf)
    with pytest.raises(ValueError):
        metrics.uno_c(df.union(spark.createDataFrame(
            pd.DataFrame({"time": [3.0], "event": [1], "score": [0.0]}))), "score")


def test_dynamic_auc_matches_brute(sdf):
    df, (t, e, s) = sdf
    times = metrics.time_grid(df)
    auc, mean = metrics.dynamic_auc(df, "score", times)
    got = auc.orderBy("k").toPandas()
    exp, emean = brute.dyn_auc(t, e, s, times)
    assert np.allclose(got.auc.to_numpy(), exp, atol=1e-12)
    assert mean.first()["mean_auc"] == pytest.approx(emean, abs=1e-12)


def test_km_matches_brute(sdf):
    df, (t, e, s) = sdf
    got = survival.kaplan_meier(df).orderBy("time").toPandas()
    exp = brute.km(t, e)
    assert np.allclose(got.survival.to_numpy(), [v for _, v in exp], atol=1e-12)
    got = survival.kaplan_meier(df, reverse=True, parts=30).orderBy("time").toPandas()
    exp = brute.km(t, e, reverse=True)
    assert np.allclose(got.survival.to_numpy(), [v for _, v in exp], atol=1e-12)
    assert (np.diff(got.survival.to_numpy()) <= 1e-15).all()


@pytest.mark.parametrize("cap", [None, 16])
def test_harrell_by_group_matches_brute(spark, cap):
    rng = np.random.default_rng(11)
    frames = []
    exp = {}
    for g in range(3):
        t, e, s = _data(n=80 + 20 * g, seed=g)
        frames.append(pd.DataFrame({"g": g, "time": t, "event": e.astype(int), "score": s}))
        exp[g] = brute.harrell(t, e, s)
    df = spark.createDataFrame(pd.concat(frames))
    kw = {} if cap is None else {"cap": cap, "parts": 7}
    got = metrics.harrell_c_by_group(df, "g", "score", **kw).set_index("g")["cindex"]
    for g, v in exp.items():
        assert got[g] == pytest.approx(v, abs=1e-12)


@pytest.mark.parametrize("parts", [2, 37])
@pytest.mark.parametrize("exclusive", [False, True])
def test_cumulative_null_segment_and_hot_key(spark, parts, exclusive):
    rows = [(None, 1.0 if i < 60 else float(i), 0.2) for i in range(100)] + [("a", float(i), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k double, v double").repartition(4)
    out = kernels.cumulative(df, ["k"], {"c": "v"}, segment=["g"], exclusive=exclusive, parts=parts).collect()
    null = sorted(r.c for r in out if r.g is None)
    assert np.allclose(null, np.arange(100) * 0.2 + (0.0 if exclusive else 0.2))
    assert sorted(r.c for r in out if r.g == "a") == [float(i) + (0.0 if exclusive else 1.0) for i in range(30)]


@pytest.mark.parametrize("descending", [False, True])
def test_cumulative_with_bounds(spark, descending):
    rows = [(g, float(i), 1.0) for g in ("a", None) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, k double, v double").repartition(4)
    bounds = kernels.key_bounds(df, "k", 9)
    assert 1 < len(bounds) < 9
    for b in (bounds, []):
        out = kernels.cumulative(df, ["k"], {"c": "v"}, segment=["g"], descending=descending, bounds=b).collect()
        assert len(out) == 160
        assert all(r.c == (80 - r.k if descending else r.k + 1) for r in out)


def test_cumulative_rejects_unknown_arguments(spark):
    with pytest.raises(TypeError):
        kernels.cumulative(spark.range(3), ["id"], {"c": F.lit(1)}, segmnt=["id"])


def test_zero_censoring_survival_raises_or_takes_pooled_outcomes(spark):
    train = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.5, 0)], "time double, event int")
    test = spark.createDataFrame([(1.5, 1, 3.0), (3.0, 1, 2.0), (4.0, 0, 1.0), (5.0, 1, 0.0)], "time double, event int, score double")
    pooled = train.unionByName(test.select("time", "event"))
    with pytest.raises(ValueError):
        metrics.uno_c(test, "score", train)
    with pytest.raises(ValueError):
        metrics.dynamic_auc(test, "score", [2.0, 3.5], train)
    assert 0.0 <= metrics.uno_c(test, "score", train, pooled=pooled)["cindex"] <= 1.0
    auc, mean = metrics.dynamic_auc(test, "score", [2.0, 3.5], train, pooled=pooled)
    assert [r.auc for r in auc.orderBy("k").collect()] == [1.0, 1.0] and mean.first()["mean_auc"] == pytest.approx(1.0)
