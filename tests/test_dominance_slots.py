import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import kernels, screen


def _rows(seed=0, n=400):
    rng = np.random.default_rng(seed)
    r = np.where(rng.random(n) < 0.3, 5.0, rng.integers(0, 40, n))  # a hot rank and a hot score
    s = np.where(rng.random(n) < 0.4, 1.0, rng.normal(size=n).round(1))
    return r, s, rng.integers(0, 3, n) * 1.0, rng.integers(1, 3, n) * 1.0


def _brute(r, s, a, b):
    on = r[:, None] < r[None]
    w = a[:, None] * b[None] * on
    return (w * (s[None] < s[:, None])).sum(), (w * (s[None] == s[:, None])).sum()


@pytest.mark.parametrize("cap", [None, 100, 7])
@pytest.mark.parametrize("unit", [False, True])
def test_dominance_with_tied_ranks_and_no_level_of_its_own(spark, monkeypatch, cap, unit):
    """Rows are dealt once to slots and strips: no ordered sum over the rows, whatever their number."""
    monkeypatch.setattr(kernels, "cumulative", None)
    r, s, a, b = _rows()
    a, b = ((a > 0) * 1.0, np.ones(len(r))) if unit else (a, b)
    dense = np.random.default_rng(1).permutation(len(r)) * 1.0
    for rank, kw in ((r, {"dense": False}), (dense, {})):
        df = spark.createDataFrame(pd.DataFrame({"r": rank, "s": s, "a": a, "b": b})).repartition(5)
        got = kernels.dominance(df, "r", "s", "a", "b", n_rows=len(r), cap=cap, **kw)
        assert got == _brute(rank, s, a, b)


def test_spearman_and_kendall_rank_the_target_without_the_rows_of_every_feature(spark, monkeypatch):
    """Nulls differ by feature; one ordered sum over y serves all features, none runs for Kendall."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"y": rng.integers(0, 30, 200) * 1.0, "a": rng.normal(size=200).round(1), "b": rng.integers(0, 2, 200) * 1.0,
                        "same": 2.0})
    pdf["a"] = pdf["a"].where(rng.random(200) < 0.8)
    df = spark.createDataFrame(pdf).selectExpr("y", "nanvl(a, null) a", "b", "same")
    calls = []
    run = screen.cumulative
    monkeypatch.setattr(screen, "cumulative", lambda *a, **k: calls.append(1) or run(*a, **k))
    got = {r["feature"]: r for r in screen.spearman(df, ["a", "b", "same"], "y").collect()}
    for c in "ab":
        on = pdf[c].notna()
        want = pdf.loc[on, c].rank().corr(pdf.loc[on, "y"].rank())
        assert got[c]["rho"] == pytest.approx(want) and got[c]["n"] == on.sum()
    assert got["same"]["rho"] is None and len(calls) == 2
    x, y = pdf["b"].to_numpy(), pdf["y"].to_numpy()
    k = screen.kendall_tau_b(df, "b", "y", cap=16)
    assert k["discordant"] == ((x[:, None] < x[None]) & (y[:, None] > y[None])).sum() and len(calls) == 2
