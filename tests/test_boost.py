import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import boost


@pytest.mark.parametrize("subsample", [1.0, 0.6])
def test_componentwise_steps_follow_the_gradient(spark, subsample):
    """Every step moves the feature of the largest gain, by brute force over all pairs; times tied and hot."""
    rng = np.random.default_rng(9)
    n, seed, rate = 60, 3, 0.1
    x = rng.normal(size=(n, 2))
    t, e = np.round(rng.exponential(np.exp(-x[:, 0])), 1) + 0.1, (rng.random(n) < 0.7).astype(int)
    t[:20] = 0.6
    ids = rng.permutation(10 ** 6)[:n]
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "time": t, "event": e, "a": x[:, 0], "b": x[:, 1]}))
    got = boost.componentwise(df, ["a", "b"], 4, rate, subsample=subsample, seed=seed, id_col="id")
    beta = np.zeros(2)
    for step in range(1, 5):
        on = ((ids + 1) * (7919 + step * 1000 + seed)) % 1000003 < int(subsample * 1000003) if subsample < 1 else np.ones(n, bool)
        tt, ee, xx = t[on], e[on], x[on]
        w, u, norm = np.exp(xx @ beta), np.zeros(2), (xx * xx).sum(axis=0)
        for i in np.flatnonzero(ee):
            r = tt >= tt[i]
            u += xx[i] - (w[r] @ xx[r]) / w[r].sum()
        k = int(np.argmax(u * u / norm))
        beta[k] += rate * u[k] / norm[k]
        own = got[got["step"] == step].set_index("feature")["coef"]
        assert np.allclose([own["a"], own["b"]], beta, atol=1e-10)


def test_componentwise_shuffles_once_for_all_steps(spark):
    """The number of steps changes no layout: a step reads the resident blocks only."""
    df = spark.createDataFrame(pd.DataFrame({"time": np.arange(1.0, 31), "event": [1, 0, 1] * 10, "a": np.arange(30.0) % 7}))
    made = []
    first = boost.ResidentRows

    class Counted(first):
        def __init__(self, *args, **kw):
            made.append(1)
            super().__init__(*args, **kw)

    boost.ResidentRows = Counted
    try:
        boost.componentwise(df, ["a"], 3)
    finally:
        boost.ResidentRows = first
    assert len(made) == 1


def _tree_rows(spark, n=300):
    """Rows whose times are tied, one of them over a third of the rows, so that it spans small blocks."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=n), np.round(2 * rng.normal(size=n)), rng.integers(0, 2, n)], 1)
    t, e = np.round(rng.exponential(np.exp(-x[:, 0])), 2) + 0.1, (rng.random(n) < 0.6).astype(int)
    t[:n // 3] = 0.7
    pdf = pd.DataFrame({"id": rng.permutation(n), "time": t, "event": e, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    return pdf, spark.createDataFrame(pdf)


def test_trees_are_those_of_spark_ml_on_brute_force_residuals(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    monkeypatch.setattr(boost, "BLOCK_ROWS", 30)
    monkeypatch.setattr(boost, "REFRESH", 2)
    pdf, df = _tree_rows(spark)
    got, models = boost.trees(df, ["a", "b", "c"], n_estimators=3, learning_rate=0.3)
    t, e, score, imps = pdf["time"].to_numpy(), pdf["event"].to_numpy(), np.zeros(len(pdf)), []
    for _ in range(3):
        w = np.exp(score)
        hazard = np.array([1 / w[t >= x].sum() for x in t]) * e
        r = e - w * np.array([hazard[t <= x].sum() for x in t])
        d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf.assign(r=r)))
        m = DecisionTreeRegressor(maxDepth=3, labelCol="r").fit(d)
        score = score + 0.3 * m.transform(d).select("id", "prediction").toPandas().set_index("id")["prediction"][pdf["id"]].to_numpy()
        imps.append(m.featureImportances.toArray())
    own = got.toPandas().set_index("id")["F"][pdf["id"]].to_numpy()
    assert got.columns == ["id", "time", "event", "features", "F"] and len(own) == len(pdf)
    assert np.allclose(own, score, atol=1e-12) and np.allclose(boost.tree_importances(models), np.mean(imps, axis=0), atol=1e-12)


def test_tree_steps_write_nothing(spark, monkeypatch):
    """More trees take no more checkpoints: a step reads the resident blocks only."""
    _, df = _tree_rows(spark, 60)
    made, first = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **kw: made.append(1) or first(self, *a, **kw))
    counts = []
    for steps in (1, 3):
        made.clear()
        boost.trees(df, ["a", "b"], n_estimators=steps, max_depth=1)
        counts.append(len(made))
    assert counts[0] == counts[1]


def test_trees_refuse_missing_values(spark):
    pdf, _ = _tree_rows(spark, 20)
    for column in ("a", "event"):
        bad = pdf.astype({column: object})
        bad.loc[3, column] = None
        df = spark.createDataFrame([tuple(r) for r in bad.itertuples(index=False)], "id long, time double, event long, a double, b double, c double"
                                   ) if column == "a" else spark.createDataFrame(pdf).selectExpr(
            "id", "time", "CASE WHEN id <> 3 THEN event END AS event", "a", "b", "c")
        with pytest.raises(ValueError):
            boost.trees(df, ["a", "b"], n_estimators=1)
