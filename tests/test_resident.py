import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import resident
from hazardflow.operators.cox import CoxFitter
from hazardflow.operators.resident import Models, ResidentRows
from tests import brute


def sample(n=240, p=3, seed=0, hot=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    t = np.round(rng.exponential(np.exp(-0.4 * x[:, 0])), 1) + 0.1
    if hot:
        t[rng.random(n) < 0.35] = 0.7  # a third of all rows at one time
    return pd.DataFrame({"id": np.arange(n), "time": t, "event": (rng.random(n) < 0.7).astype(int),
                         **{f"f{j}": x[:, j] for j in range(p)}})


def brute_terms(t, e, x, beta, efron):
    """Log partial likelihood, gradient and information by the formulas, one time after another."""
    p = x.shape[1]
    w, ll, u, info = np.exp(x @ beta), 0.0, np.zeros(p), np.zeros((p, p))
    for v in np.unique(t[e > 0]):
        risk, die = t >= v, (t == v) & (e > 0)
        d = int(die.sum())
        ll += (x[die] @ beta).sum()
        u += x[die].sum(axis=0)
        for k in range(d):
            c = k / d if efron else 0.0
            ww = w * risk - c * w * die
            s0, s1, s2 = ww.sum(), ww @ x, (x * ww[:, None]).T @ x
            ll -= np.log(s0)
            u -= s1 / s0
            info += s2 / s0 - np.outer(s1, s1) / s0 ** 2
    return ll, u, info


@pytest.mark.parametrize("block_rows", [7, 1 << 16])
def test_pass_matches_the_formulas(spark, block_rows):
    pdf = sample()
    feats = ["f0", "f1", "f2"]
    rng = np.random.default_rng(1)
    folds = pd.DataFrame([(i, f, bool(rng.random() < 0.3)) for f in range(3) for i in pdf["id"] if not (f == 2 and i % 5 == 0)],
                         columns=["id", "fold", "is_test"])
    rows = ResidentRows(spark.createDataFrame(pdf), feats, "id", spark.createDataFrame(folds), parts=3, block_rows=block_rows)
    fold = np.array([0, 0, 1, 2, 2])
    efron = np.array([False, True, True, False, True])
    models = Models(fold, np.zeros(5), efron, np.ones((5, 3), bool))
    beta = rng.normal(scale=0.6, size=(5, 3))
    ll, u, info = rows.evaluate(models, beta)
    for k in range(5):
        ids = folds[(folds["fold"] == fold[k]) & ~folds["is_test"]]["id"]
        own = pdf[pdf["id"].isin(ids)]
        want = brute_terms(own["time"].to_numpy(), own["event"].to_numpy(), own[feats].to_numpy(), beta[k], efron[k])
        assert ll[k] == pytest.approx(want[0], rel=1e-10)
        assert np.allclose(u[k], want[1], atol=1e-8) and np.allclose(info[k], want[2], atol=1e-8)
    c = rows.concordance(fold, beta)
    for k in range(5):
        own = pdf[pdf["id"].isin(folds[(folds["fold"] == fold[k]) & folds["is_test"]]["id"])]
        assert c["cindex"][k] == pytest.approx(brute.harrell(own["time"].to_numpy(), own["event"].to_numpy() > 0,
                                                             own[feats].to_numpy() @ beta[k]))
        assert c["n"][k] == len(own)
    rows.close()


def test_groups_of_models_and_large_folds_change_nothing(spark, monkeypatch):
    pdf = sample(90)
    df = spark.createDataFrame(pdf)
    folds = spark.createDataFrame(pd.DataFrame({"id": pdf["id"], "fold": 0, "is_test": pdf["id"] % 3 == 0}))
    rows = ResidentRows(df, ["f0", "f1"], "id", folds, parts=3, block_rows=11)
    models = Models(np.zeros(4, int), np.arange(4.0), np.array([True, False] * 2), np.ones((4, 2), bool))
    beta = np.random.default_rng(2).normal(size=(4, 2))
    whole, c = rows.evaluate(models, beta), rows.concordance(models.fold, beta)
    monkeypatch.setattr(resident, "DRIVER_NUMBERS", 1)
    monkeypatch.setattr(resident, "TASK_NUMBERS", 1)
    monkeypatch.setattr(resident, "TEST_ROWS", 5)
    for a, b in zip(whole, rows.evaluate(models, beta), strict=True):
        assert np.allclose(a, b, atol=1e-10)
    assert np.allclose(c["cindex"], rows.concordance(models.fold, beta)["cindex"], atol=1e-12)
    rows.close()


def test_fits_equal_single_fits(spark):
    pdf = sample(160, 3, 5)
    df = spark.createDataFrame(pdf)
    rows = ResidentRows(df, ["f0", "f1", "f2"], parts=3, block_rows=20)
    active = np.array([[True] * 3, [True] * 3, [True, False, True]])
    fits = rows.fit(Models(np.zeros(3, int), np.array([0.0, 0.5, 0.1]), np.array([False, True, True]), active))
    assert fits.converged.all()
    for k, (ties, alpha) in enumerate((("breslow", 0.0), ("efron", 0.5), ("efron", 0.1))):
        one = CoxFitter(ties=ties, alpha=alpha).fit(df, ["f0", "f1", "f2"], masks={0: active[k]})
        assert np.allclose(fits.beta[k], one.beta[0], atol=1e-8)
        assert fits.loglik[k] == pytest.approx(one.loglik[0], rel=1e-9)
    rows.close()


def test_tie_sums_do_not_depend_on_the_number_of_terms():
    for d in (1, 2, 24, 25, 1000, 10**6):
        for a in (float(d), d + 0.25, 3.7 * d, 1e4 * d):
            x = a - np.arange(d)[::-1]
            want = (np.log(x).sum(), (1 / x).sum(), (1 / x ** 2).sum())
            for got, true in zip(resident.tie_sums(a, d), want, strict=True):
                assert got == pytest.approx(true, rel=1e-10, abs=1e-12)


def test_empty_table_and_no_events(spark):
    df = spark.createDataFrame(sample(20)).withColumn("event", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    none = ResidentRows(df, ["f0"], parts=2)
    fit = none.fit(Models(np.zeros(1, int), np.ones(1), np.zeros(1, bool), np.ones((1, 1), bool)))
    assert fit.beta[0, 0] == 0 and fit.loglik[0] == 0
    empty = ResidentRows(df.limit(0), ["f0"], parts=2)
    assert empty.n == 0 and empty.fit(Models(np.zeros(1, int), np.ones(1), np.zeros(1, bool), np.ones((1, 1), bool))).passes == 0


def test_large_folds_with_tied_scores_and_hot_classes(spark, monkeypatch):
    """Slots and strips count what a comparison of all pairs does: a time over many blocks, scores of few and of many values."""
    pdf = sample(400, 2, 11)
    pdf["f1"] = np.random.default_rng(4).integers(0, 3, 400).astype(float)
    df = spark.createDataFrame(pdf)
    folds = spark.createDataFrame(pd.DataFrame([(int(i), f, bool(i % (f + 2) == 0)) for i in pdf["id"] for f in range(2)],
                                               columns=["id", "fold", "is_test"]))
    rows = ResidentRows(df, ["f0", "f1"], "id", folds, parts=3, block_rows=13)
    monkeypatch.setattr(resident, "TEST_ROWS", 5)
    fold, beta = np.array([0, 0, 1, 1, 0]), np.array([[1.0, 0.5], [0.0, 1.0], [0.0, -2.0], [-0.3, 0.1], [0.0, 0.0]])
    for on in ("test", "train"):
        c = rows.concordance(fold, beta, on)
        for k in range(len(fold)):
            own = pdf[(pdf["id"] % (fold[k] + 2) == 0) == (on == "test")]
            s = own["f0"].to_numpy() * beta[k, 0] + own["f1"].to_numpy() * beta[k, 1]
            assert c["cindex"][k] == pytest.approx(brute.harrell(own["time"].to_numpy(), own["event"].to_numpy() > 0, s), abs=1e-12)
            assert c["n"][k] == len(own)
    rows.close()
