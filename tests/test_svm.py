import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import svm


def _pairs(t, e):
    n = len(t)
    return [(i, j) for i in range(n) for j in range(n)
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j] and i != j))]


def _brute(X, t, e, w, shift=0.0):
    s = X @ w
    L = 0.0
    g = np.zeros(X.shape[1])
    H = np.zeros((X.shape[1],) * 2)
    for i, j in _pairs(t, e):
        z = s[i] - s[j]
        if z < 1 - shift:
            L += (1 - z) ** 2
            d = X[i] - X[j]
            g += -2 * (1 - z) * d
            H += 2 * np.outer(d, d)
    return L, g, H


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 120
    X = rng.normal(size=(n, 3))
    t = rng.integers(1, 15, n).astype(float)    # ties in time
    e = rng.random(n) < 0.6
    pdf = pd.DataFrame({"time": t, "event": e.astype(int), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2]})
    return spark.createDataFrame(pdf), X, t, e


@pytest.mark.parametrize("cap", [None, 20])
def test_pair_stats_match_brute(data, cap):
    df, X, t, e = data
    d = svm._prepare(df, ["a", "b", "c"], "time", "event")
    st = svm.PairStats(d, 3, cap)
    w = np.array([0.3, -0.2, 0.5])
    for shift in (0.0, 0.3):
        L, g, H, _ = st(w, shift)
        bL, bg, bH = _brute(X, t, e, w, shift)
        assert L == pytest.approx(bL, rel=1e-10)
        assert np.allclose(g, bg, atol=1e-8)
        assert np.allclose(H, bH, atol=1e-8)


def test_rank_svm_stationary(data):
    df, X, t, e = data
    r = svm.fit_rank_svm(df, ["a", "b", "c"], alpha=0.5)
    _, g, _ = _brute(X, t, e, r.coef)
    assert np.allclose(r.coef + 0.25 * g, 0, atol=1e-6)


def _smoothed(X, t, e, w, delta):
    s = X @ w
    f = 0.0
    for i, j in _pairs(t, e):
        z = s[i] - s[j]
        if z >= 1:
            continue
        f += (1 - z) ** 2 / (2 * delta) if z > 1 - delta else 1 - z - delta / 2
    return f


def test_smoothed_hinge_value_and_gradient(data):
    df, X, t, e = data
    d = svm._prepare(df, ["a", "b", "c"], "time", "event")
    st = svm.PairStats(d, 3)
    w = np.array([0.3, -0.2, 0.5])
    f, g, _, _ = svm._smoothed_hinge(st, w, 0.3)
    assert f == pytest.approx(_smoothed(X, t, e, w, 0.3), rel=1e-10)
    h = 1e-6
    num = np.array([(_smoothed(X, t, e, w + h * v, 0.3) - _smoothed(X, t, e, w - h * v, 0.3)) / (2 * h)
                    for v in np.eye(3)])
    assert np.allclose(g, num, atol=1e-4)


def test_hinge_is_solved_at_the_last_level(data):
    df, X, t, e = data
    r = svm.fit_rank_svm(df, ["a", "b", "c"], alpha=1.0, loss="hinge")
    h = 1e-6
    g = np.array([(_smoothed(X, t, e, r.coef + h * v, 0.01) - _smoothed(X, t, e, r.coef - h * v, 0.01)) / (2 * h)
                  for v in np.eye(3)])
    assert r.converged and np.allclose(r.coef + g, 0, atol=1e-3)


def test_a_fit_that_reached_its_limit_says_so(data, monkeypatch):
    df, *_ = data
    monkeypatch.setattr(svm, "HINGE_STEPS", 1)
    assert not svm.fit_rank_svm(df, ["a", "b", "c"], loss="hinge", max_iter=1).converged
    assert not svm.fit_rank_svm(df, ["a", "b", "c"], alpha=0.5, max_iter=1).converged


def _hard(seed=3, n=150):
    """Half of the rows at one time, repeated rows, scores tied by a coarse feature."""
    rng = np.random.default_rng(seed)
    X = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 2, n)]).astype(float)
    t = np.where(rng.random(n) < 0.5, 7.0, rng.integers(1, 12, n)).astype(float)
    e = rng.random(n) < 0.5
    return X, t, e


def _frame(spark, X, t, e):
    return spark.createDataFrame(pd.DataFrame({"time": t, "event": e.astype(int), "a": X[:, 0], "b": X[:, 1]}))


@pytest.mark.parametrize("cap", [None, 8])
def test_pair_sums_with_a_hot_time_and_tied_scores(spark, cap):
    X, t, e = _hard()
    st = svm.PairStats(svm._prepare(_frame(spark, X, t, e), ["a", "b"], "time", "event"), 2, cap)
    points = [([0.5, -1.0], 0.0, 0.0), ([0.0, 0.0], 0.25, 1.0), ([1.0, 1.0], 0.5, -0.5)]
    for (w, shift, b), r in zip(points, st.at(points, residuals=True), strict=True):
        w = np.array(w)
        L, g, H = _brute(X, t, e, w, shift)
        z = np.array([(X[i] - X[j]) @ w for i, j in _pairs(t, e)])
        d = np.array([X[i] - X[j] for i, j in _pairs(t, e)])
        on = z < 1 - shift
        assert r.count == on.sum() and r.square == pytest.approx(L) and r.linear == pytest.approx((1 - z[on]).sum())
        assert np.allclose(r.square_grad, g) and np.allclose(r.square_hess, H)
        assert np.allclose(r.linear_grad, -d[on].sum(axis=0))
        res = np.log(t) - (b - X @ w)
        res = np.where(e | (res > 0), res, 0)
        assert r.residual == pytest.approx((res ** 2).sum())
        assert np.allclose(r.residual_grad, 2 * np.append(res @ X, -res.sum()))
    st.close()


def test_dominance_sums_match_a_double_loop():
    rng = np.random.default_rng(0)
    qr, vr = rng.integers(0, 6, 40), rng.integers(0, 6, 50)
    qk, vk = rng.integers(0, 4, 40) * 1.0, rng.integers(0, 4, 50) * 1.0
    qw, feats = rng.random(40), rng.random((50, 2))
    from hazardflow.operators.pairs import dominance_sums
    sums, counts = dominance_sums(qr, qk, qw, vr, vk, feats)
    on = (vr[None] > qr[:, None]) & (vk[None] > qk[:, None])
    assert np.allclose(sums, on @ feats) and np.allclose(counts, qw @ on)


@pytest.mark.parametrize(("ratio", "intercept"), [(0.0, True), (0.5, True), (0.5, False)])
def test_mixed_objective_is_stationary(data, ratio, intercept):
    df, X, t, e = data
    r = svm.fit_rank_svm(df, ["a", "b", "c"], alpha=0.7, rank_ratio=ratio, fit_intercept=intercept, max_iter=40)
    _, g, _ = _brute(X, t, e, r.coef)
    res = np.log(t) - (r.intercept - X @ r.coef)
    res = np.where(e | (res > 0), res, 0)
    assert r.converged
    assert np.allclose(r.coef + 0.35 * (ratio * g + (1 - ratio) * 2 * res @ X), 0, atol=1e-5)
    assert not intercept or abs(res.sum()) < 1e-4
    got = df.select(svm.predicted_time(r, ["a", "b", "c"])).toPandas().iloc[:, 0]
    assert np.allclose(got, np.exp(r.intercept - X @ r.coef))


def test_l1_fit_meets_the_subgradient_conditions(data):
    df, X, t, e = data
    least = np.sort(np.abs(_brute(X, t, e, np.zeros(3))[1]))
    alpha = 2 / least[:2].mean()  # the weakest feature stays out
    r = svm.fit_rank_svm(df, ["a", "b", "c"], alpha=alpha, penalty="l1", max_iter=40)
    g = 0.5 * alpha * _brute(X, t, e, r.coef)[1]
    on = np.abs(r.coef) > 1e-9
    assert r.converged and 0 < on.sum() < 3
    assert np.allclose(g[on], -np.sign(r.coef[on]), atol=1e-5) and (np.abs(g[~on]) <= 1 + 1e-6).all()


def test_svm_edges(spark, data):
    df, *_ = data
    none = svm.fit_rank_svm(df.limit(0), ["a", "b"])
    assert none.converged and (none.coef == 0).all() and none.active_pairs == 0
    for wrong in ({"rank_ratio": 1.5}, {"rank_ratio": 0.5, "loss": "hinge"}, {"fit_intercept": True}):
        with pytest.raises(ValueError):
            svm.fit_rank_svm(df, ["a"], **wrong)
    with pytest.raises(ValueError, match="positive"):
        svm.fit_rank_svm(_frame(spark, np.zeros((2, 2)), np.array([0.0, 1.0]), np.array([True, False])), ["a"], rank_ratio=0.5)
