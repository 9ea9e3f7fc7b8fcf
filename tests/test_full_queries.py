import numpy as np

from hazardflow.plans import q_screen, q_survival
from hazardflow.sources import views
from tests.conftest import SF001


def test_paths_take_every_feature(spark):
    lasso = q_screen.lasso_path(spark, SF001).toPandas()
    assert set(lasso["feature"]) == set(q_screen.EVERY)
    ridge = q_screen.ridge_path_full(spark, SF001).toPandas()
    ev = views.surv_events(spark, SF001).select(*q_screen.EVERY, "time").dropna().toPandas().astype(float)
    X, y = ev[q_screen.EVERY].to_numpy(), ev["time"].to_numpy()
    for i in (0, 50, 99):
        part = ridge[ridge["i"] == i].set_index("feature")
        w = np.linalg.solve(X.T @ X + 10 ** part["log10_alpha"].iloc[0] * np.eye(7), X.T @ y)
        assert np.allclose(part.loc[q_screen.EVERY, "coef"], w, rtol=1e-6, atol=1e-8)


def test_seven_methods_vote_on_seven_features(spark):
    v = q_screen.topk_vote_full(spark, SF001).toPandas()
    assert set(v["feature"]) == set(q_screen.EVERY)
    votes = v["true_ratio"] * 7
    assert np.allclose(votes, votes.round(), atol=1e-4)


def test_univariate_has_the_c_index(spark):
    t = q_survival.cox_univariate_full(spark, SF001).toPandas()
    assert set(t["feature"]) == set(q_screen.EVERY)
    assert t["cindex"].between(0, 1).all() and t["p"].between(0, 1).all()
