import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import cox, coxnet
from tests import brute


def _data(n=150, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 2))
    t = rng.integers(1, 12, n).astype(float)      # tied event times
    e = (rng.random(n) < 0.7).astype(int)
    return X, t, e


def _loglik(X, t, e, b, ties):
    lp = X @ b
    w = np.exp(lp)
    ll = 0.0
    for u in np.unique(t[e == 1]):
        ev = (t == u) & (e == 1)
        d = ev.sum()
        risk = w[t >= u].sum()
        e0 = w[ev].sum()
        ll += lp[ev].sum()
        if ties == "breslow":
            ll -= d * np.log(risk)
        else:
            ll -= sum(np.log(risk - l / d * e0) for l in range(d))
    return ll


@pytest.fixture(scope="module")
def df(spark):
    X, t, e = _data()
    pdf = pd.DataFrame({"time": t, "event": e, "a": X[:, 0], "b": X[:, 1]})
    return spark.createDataFrame(pdf), (X, t, e)


@pytest.mark.parametrize("ties", ["breslow", "efron"])
@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_fit_is_stationary(df, ties, alpha):
    sdf, (X, t, e) = df
    r = cox.CoxFitter(ties=ties, alpha=alpha).fit(sdf, ["a", "b"])
    b = r.beta[0]
    h = 1e-6
    grad = np.array([(_loglik(X, t, e, b + h * v, ties) - _loglik(X, t, e, b - h * v, ties)) / (2 * h)
                     for v in np.eye(2)])
    assert np.allclose(grad - alpha * b, 0, atol=1e-5)
    assert r.loglik[0] == pytest.approx(_loglik(X, t, e, b, ties), rel=1e-10)


def test_information_matches_numeric_hessian(df):
    sdf, (X, t, e) = df
    r = cox.CoxFitter(ties="efron").fit(sdf, ["a", "b"])
    b = r.beta[0]
    h = 1e-4
    H = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            ei, ej = np.eye(2)[i] * h, np.eye(2)[j] * h
            H[i, j] = (_loglik(X, t, e, b + ei + ej, "efron") - _loglik(X, t, e, b + ei - ej, "efron")
                       - _loglik(X, t, e, b - ei + ej, "efron") + _loglik(X, t, e, b - ei - ej, "efron")) / (4 * h * h)
    assert np.allclose(r.information[0], -H, rtol=1e-4)


def test_distributed_cumulative_path_same_fit(df):
    sdf, _ = df
    a = cox.CoxFitter(ties="efron").fit(sdf, ["a", "b"]).beta
    b = cox.CoxFitter(ties="efron").fit(sdf, ["a", "b"]).beta
    assert np.allclose(a, b, atol=1e-10)


def test_univariate_matches_single_fits(df):
    from tests import brute
    sdf, (X, t, e) = df
    tab = cox.univariate_cox(sdf, ["a", "b"], with_cindex=True).set_index("feature")
    for j, f in enumerate(["a", "b"]):
        single = cox.CoxFitter(ties="efron").fit(sdf, [f]).beta[0, 0]
        assert tab.loc[f, "coef"] == pytest.approx(single, abs=1e-9)
        score = X[:, j] * (1.0 if single >= 0 else -1.0)
        assert tab.loc[f, "cindex"] == pytest.approx(brute.harrell(t, e.astype(bool), score), abs=1e-12)


def test_coxnet_kkt_at_last_alpha(df):
    sdf, (X, t, e) = df
    path = coxnet.fit_path(sdf, ["a", "b"], l1_ratio=0.2, n_alphas=20)
    b = path.coefs[-1]
    a = path.alphas[-1]
    n = len(t)
    h = 1e-6
    g = np.array([(_loglik(X, t, e, b + h * v, "breslow") - _loglik(X, t, e, b - h * v, "breslow")) / (2 * h * n)
                  for v in np.eye(2)])
    # stationarity of logPL/n - a*(0.2|b|_1 + 0.4 b^2) where b != 0
    for j in range(2):
        if abs(b[j]) > 1e-8:
            assert g[j] - a * (0.2 * np.sign(b[j]) + 0.8 * b[j]) == pytest.approx(0, abs=1e-5)
        else:
            assert abs(g[j]) <= a * 0.2 + 1e-6


def test_coxnet_every_alpha_is_solved(df):
    sdf, (X, t, e) = df
    path = coxnet.fit_path(sdf, ["a", "b"], l1_ratio=0.2, n_alphas=5, alpha_min_ratio=1e-2)
    n, h = len(t), 1e-6
    assert path.converged.all()
    for a, b, ll in zip(path.alphas, path.coefs, path.loglik):
        g = np.array([(_loglik(X, t, e, b + h * v, "breslow") - _loglik(X, t, e, b - h * v, "breslow")) / (2 * h * n)
                      for v in np.eye(2)])
        for j in range(2):
            if abs(b[j]) > 1e-8:
                assert g[j] - a * (0.2 * np.sign(b[j]) + 0.8 * b[j]) == pytest.approx(0, abs=1e-5)
            else:
                assert abs(g[j]) <= a * 0.2 + 1e-6
        assert ll == pytest.approx(_loglik(X, t, e, b, "breslow"), abs=1e-6)
    assert not coxnet.fit_path(sdf, ["a", "b"], n_alphas=3, max_passes=1).converged.all()


def test_one_step_of_overlapping_models(spark):
    """Rows that train several models are laid out once; a null leaves a row out of its column's models only."""
    rng = np.random.default_rng(7)
    n = 160
    t, e = np.round(rng.exponential(1.0, n), 1) + 0.1, (rng.random(n) < 0.6).astype(int)
    t[:50] = 0.7
    x = {"a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))}
    member = rng.random((n, 3)) < 0.6
    rows = [(float(t[i]), int(e[i]), float(x["a"][i]), None if np.isnan(x["b"][i]) else float(x["b"][i]),
             [f for f in range(3) if member[i, f]]) for i in range(n)]
    sdf = spark.createDataFrame(rows, "time double, event int, a double, b double, own array<int>")
    got = cox.one_step(sdf, ["a", "b"], "own", univariate=True)
    assert set(got) == {(f, c) for f in range(3) for c in "ab"}
    for (f, c), beta in got.items():
        on = member[:, f] & ~np.isnan(x[c])
        tt, ee, xx, u, info = t[on], e[on], x[c][on], 0.0, 0.0
        for i in np.flatnonzero(ee):
            r = xx[tt >= tt[i]]
            u, info = u + xx[i] - r.mean(), info + r.var()
        assert abs(float(beta[0]) - u / info) < 1e-9


def test_univariate_models_share_one_layout(spark, monkeypatch):
    """Features without nulls share a layout of the rows, another one has its own non-null rows; values as single fits."""
    from hazardflow.operators import resident

    rng = np.random.default_rng(3)
    n = 120
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame({"time": np.round(rng.exponential(1.0, n), 1) + 0.1, "event": (rng.random(n) < 0.7).astype(int),
                        "a": x[:, 0], "b": x[:, 1], "c": np.where(rng.random(n) < 0.3, np.nan, x[:, 2])})
    made = []
    first = resident.ResidentRows.__init__
    monkeypatch.setattr(resident.ResidentRows, "__init__", lambda self, *a, **kw: (made.append(1), first(self, *a, **kw))[1])
    tab = cox.univariate_cox(spark.createDataFrame(pdf), ["a", "b", "c"]).set_index("feature")
    assert len(made) == 2
    for f in "abc":
        own = pdf[["time", "event", f]].dropna()
        r = cox.CoxFitter(ties="efron").fit(spark.createDataFrame(own), [f])
        assert tab.loc[f, "coef"] == pytest.approx(r.beta[0, 0], abs=1e-9)
        assert tab.loc[f, "se_coef"] == pytest.approx(r.se()[0, 0], rel=1e-9)
        assert tab.loc[f, "loglik0"] == pytest.approx(r.loglik0[0], rel=1e-12)
        assert tab.loc[f, "cindex"] == pytest.approx(brute.harrell(
            own["time"].to_numpy(), own["event"].to_numpy() > 0, own[f].to_numpy() * np.sign(r.beta[0, 0])), abs=1e-12)
