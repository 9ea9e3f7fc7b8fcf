import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import pairs, svm


def _frame(spark, n=900):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 2))
    t = np.round(rng.exponential(np.exp(-x[:, 0])), 2) + 0.1
    return spark.createDataFrame(pd.DataFrame({"time": t, "event": (rng.random(n) < 0.6).astype(int), "a": x[:, 0], "b": x[:, 1]}))


def test_hinge_of_many_rows_takes_few_passes_over_all_of_them(spark, monkeypatch):
    """Shares of the rows start the fit; the minimum over all rows is the same."""
    df, points = _frame(spark), []
    run = svm.PairStats.at

    def at(self, p, residuals=False):
        if self.share == 1:
            points.append(len(p))
        return run(self, p, residuals)

    monkeypatch.setattr(svm.PairStats, "at", at)
    want, whole = svm.fit_rank_svm(df, ["a", "b"], loss="hinge"), sum(points)
    points.clear()
    monkeypatch.setattr(svm, "START_ROWS", 100)
    got = svm.fit_rank_svm(df, ["a", "b"], loss="hinge")
    assert want.converged and got.converged and got.objective == pytest.approx(want.objective, rel=1e-9)
    assert np.allclose(got.coef, want.coef, rtol=1e-4, atol=1e-5) and sum(points) < whole / 3


def test_points_are_taken_in_groups_and_tasks_get_their_slots_lines(spark, monkeypatch):
    """The table is no part of the tasks' code; the sums don't depend on how many points a pass takes."""
    rows = pairs.PairRows(svm._prepare(_frame(spark), ["a", "b"], "time", "event"), 2, 60)
    points = [[0.3, -0.2, 0.0, 0.0], [1.0, 0.5, 0.2, 0.0], [0.0, 0.0, 0.0, 0.0]]
    together = rows.evaluate(points)
    calls = []
    run = pairs.PairRows._tables
    monkeypatch.setattr(pairs.PairRows, "_tables", lambda self, p, c: calls.append(len(p)) or run(self, p, c))
    monkeypatch.setattr(pairs, "TABLE_BYTES", 1)
    for a, b in zip(together, rows.evaluate(points), strict=True):
        assert a.count == b.count and np.allclose(a.square_hess, b.square_hess) and np.allclose(a.linear_grad, b.linear_grad)
    assert calls == [1, 1, 1]
    rows.close()


def test_hinge_leaves_a_start_without_curvature_at_any_number_of_pairs(spark):
    """A penalty that many times smaller than the loss gave steps too long for any length tried; the fit ended where it began."""
    r = svm.fit_rank_svm(_frame(spark, 300), ["a", "b"], alpha=1e16, loss="hinge")
    want = svm.fit_rank_svm(_frame(spark, 300), ["a", "b"], alpha=1e3, loss="hinge")
    assert np.allclose(r.coef, want.coef, rtol=0.02, atol=1e-3)
