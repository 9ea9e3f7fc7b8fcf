import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import describe, prep, screen
from tests import brute


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 200
    x = np.round(rng.normal(size=n) * 3, 1)
    y = np.round(rng.exponential(size=n) * 5, 1) + 0.1
    z = rng.integers(0, 4, n).astype(float)
    xm = x.copy()
    xm[::7] = np.nan
    pdf = pd.DataFrame({"x": x, "xm": xm, "y": y, "z": z, "event": (rng.random(n) < 0.5).astype(int)})
    return spark.createDataFrame(pdf), pdf


def test_standard_uses_population_sd(data):
    df, pdf = data
    s = prep.Standard().fit(df, ["x"])
    assert s.scale["x"] == pytest.approx(pdf.x.std(ddof=0))


def test_robust_and_quantile_transform(data):
    df, pdf = data
    r = prep.Robust(10, 90).fit(df, ["x"])
    assert r.center["x"] == pytest.approx(np.percentile(pdf.x, 50))
    assert r.scale["x"] == pytest.approx(np.percentile(pdf.x, 90) - np.percentile(pdf.x, 10))
    qt = prep.Quantile(50).fit(df, ["x"])
    got = df.select(qt.columns({"x": F.col("x")})["x"].alias("q")).toPandas().q.to_numpy()
    qs = np.percentile(pdf.x, np.linspace(0, 100, 50))
    refs = np.linspace(0, 1, 50)
    exp = 0.5 * (np.interp(pdf.x, qs, refs) - np.interp(-pdf.x, -qs[::-1], -refs[::-1]))
    assert np.allclose(got, exp, atol=1e-12)


def test_power_lambda_near_optimum(data):
    df, pdf = data
    pt = prep.Power().fit(df, ["y"])
    lam = pt.lmbda["y"]

    def llf(l):
        v = np.log1p(pdf.y) if abs(l) < 1e-12 else ((pdf.y + 1) ** l - 1) / l
        return -len(v) / 2 * np.log(v.var()) + (l - 1) * np.sum(np.log1p(pdf.y))
    grid = np.linspace(-2, 2, 4001)
    best = grid[np.argmax([llf(g) for g in grid])]
    assert abs(lam - best) < 0.02


def test_imputers(data):
    df, pdf = data
    for strat, exp in [("mean", pdf.xm.mean()), ("median", pdf.xm.median()),
                       ("most_frequent", pdf.xm.value_counts().sort_index().idxmax())]:
        imp = prep.Imputer(strat).fit(df, ["xm"])
        if strat == "most_frequent":
            vc = pdf.xm.value_counts()
            exp = min(vc[vc == vc.max()].index)
        assert imp.stats["xm"] == pytest.approx(exp)


def test_spearman_kendall_against_formulas(data):
    df, pdf = data
    sp = screen.spearman(df, ["x", "z"], "y").toPandas().set_index("feature")
    for f in ["x", "z"]:
        rx = pdf[f].rank(method="average")
        ry = pdf.y.rank(method="average")
        assert sp.loc[f, "rho"] == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-12)
    kd = screen.kendall(df, ["z"], "y", cap=16, parts=9).set_index("feature")
    xv, yv = pdf.z.to_numpy(), pdf.y.to_numpy()
    s = sum(np.sign(xv[i] - xv[j]) * np.sign(yv[i] - yv[j]) for i in range(len(xv)) for j in range(i))
    n0 = len(xv) * (len(xv) - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(xv).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(yv).value_counts())
    assert kd.loc["z", "tau"] == pytest.approx(s / math.sqrt((n0 - tx) * (n0 - ty)), abs=1e-12)


def test_vif_and_pca(data):
    df, pdf = data
    v = describe.vif(df, ["x", "y", "z"]).toPandas().set_index("feature")
    c = np.corrcoef(pdf[["x", "y", "z"]].to_numpy().T)
    assert np.allclose(v.loc[["x", "y", "z"], "vif"].to_numpy(), np.diag(np.linalg.inv(c)))
    m = describe.PCA(0.95).fit(df, ["x", "y", "z"])
    ev = np.sort(np.linalg.eigvalsh(np.cov(pdf[["x", "y", "z"]].to_numpy().T)))[::-1]
    assert np.allclose(m.explained_variance, ev[:len(m.explained_variance)])


def test_quantiles_interpolate_exactly_at_any_size(spark):
    import numpy as np

    from hazardflow.operators.prep import quantiles

    rng = np.random.default_rng(4)
    x, y = np.arange(1000.0), rng.integers(0, 5, 1000).astype(float)
    rows = [(float(a), float(b), None, float("nan") if i % 3 else float(a)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, none double, some double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = quantiles(df, ["x", "y", "none", "some"], probs)
    assert got["x"][3] == 499.5 and got["x"][1] == pytest.approx(99.9)
    for c, v in (("x", x), ("y", y), ("some", x[::3])):
        assert got[c] == pytest.approx(list(np.quantile(v, probs)), abs=1e-12)
    assert got["none"] == [None] * len(probs)


def test_power_lambda_is_the_maximum_wherever_it_lies(spark):
    import math

    import numpy as np

    from hazardflow.operators.prep import Power

    rng = np.random.default_rng(5)
    left = 1.0 - rng.exponential(0.05, 800)  # needs a lambda far above 2
    mixed = rng.normal(size=800) * 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(left, mixed)], "a double, b double").repartition(4)
    p = Power().fit(df, ["a", "b"])

    def llf(x, lam):
        rate, size = np.where(x >= 0, lam, 2 - lam), np.log1p(np.abs(x))
        y = np.sign(x) * np.expm1(rate * size) / rate
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * size).sum()

    assert p.lmbda["a"] > 4
    for c, x in (("a", left), ("b", mixed)):
        lam = p.lmbda[c]
        assert all(llf(x, lam) >= llf(x, lam + d) - 1e-9 for d in (-1e-3, -1e-5, 1e-5, 1e-3, 1.0, -1.0))


def test_chain_takes_text_categories(spark):
    from hazardflow.operators.prep import ScalerChain

    df = spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(30)], "id int, c string")
    got = ScalerChain(["OE", "M"]).fit(df, ["c"]).transform(df).orderBy("id").collect()
    assert [r.c for r in got[:4]] == [None, 0.5, 1.0, 0.0]
    hot = ScalerChain(["OH", "S"]).fit(df, ["c"])
    assert sorted(hot.out_cols) == ["c_a", "c_b", "c_c"]
    assert abs(sum(r.c_a for r in hot.transform(df).collect() if r.c_a is not None)) < 1e-9


def test_custom_stat_merges_states(spark):
    from hazardflow.operators import screen

    mean = screen.Statistic(lambda x, y: [float((x * y).sum()), float(len(x))], lambda a, b: [a[0] + b[0], a[1] + b[1]],
                            lambda s: (s[0] / s[1], 0.5))
    df = spark.createDataFrame([(float(i), float(-i), 2.0) for i in range(100)], "a double, b double, y double").repartition(7)
    got = {r.feature: r.score for r in screen.custom_stat(df, ["a", "b"], "y", mean).collect()}
    assert got == {"a": 99.0, "b": -99.0}


@pytest.mark.parametrize("rate, kept", [(0, 3), (1, 3), (0.34, 1), (2, 2), (50, 3)])
def test_rank_aggregate_rates(spark, rate, kept):
    from hazardflow.operators.search import rank_aggregate

    ranks = [(f, run, 1 if run < n else 2) for f, n in (("a", 3), ("b", 2), ("c", 1)) for run in range(3)]
    out = rank_aggregate(spark.createDataFrame(ranks, "feature string, run int, rank int"), rate)
    assert out.filter("kept").count() == kept


def test_gram_and_covariance_of_many_features(spark):
    import numpy as np

    from hazardflow.operators import describe, kernels

    rng = np.random.default_rng(6)
    x = rng.normal(size=(133, 132)) + 1e6
    cols = [f"f{i}" for i in range(132)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    g, h, n = kernels.gram(df, cols, y="f0")
    assert np.allclose(g, x.T @ x) and np.allclose(h, x.T @ x[:, 0]) and n == 133
    cov, mean, rows = describe.covariance(df, cols)
    assert rows == 133 and np.allclose(mean, x.mean(axis=0))
    assert np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    r = {(a.feature_a, a.feature_b): a.r for a in describe.pearson_long(df.select(*cols[:4]), cols[:4]).collect()}
    assert r["f0", "f3"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 3])[0, 1], abs=1e-6) and r["f1", "f1"] == 1.0
