"""Registered queries: fitted models (rows-only checks: iterative fits)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.dist import norm_two_sided
from ..operators import boost, cox, coxnet, metrics, prep, svm
from ..sources import views as V
from .registry import query, r6

EV_FEATURES = ["value", "k", "hour", "is_click", "is_view"]
LINE_FEATURES = ["l_discount", "l_tax", "o_totalprice", "p_size", "c_acctbal"]


def standardised_events(spark, sf):
    ev = V.surv_events(spark, sf)
    sc = prep.Standard().fit(ev, EV_FEATURES)
    ex = sc.columns({c: prep.clean(c) for c in EV_FEATURES})
    return ev.select("event_id", "time", "event", *[e.alias(c) for c, e in ex.items()])


def standardised_lines(spark, sf):
    li = V.surv_lines(spark, sf)
    sc = prep.Standard().fit(li, LINE_FEATURES)
    ex = sc.columns({c: prep.clean(c) for c in LINE_FEATURES})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "time", "event",
                     *[e.alias(c) for c, e in ex.items()])


def _coef_frame(spark, features, beta, se=None, extra=None):
    rows = []
    for j, f in enumerate(features):
        b = float(beta[j])
        r = {"feature": f, "coef": b, "exp_coef": float(np.exp(np.clip(b, -700, 700)))}
        if se is not None:
            s = float(se[j])
            r.update({"se_coef": s, "z": b / s if s > 0 else float("nan"),
                      "p": norm_two_sided(b / s) if s > 0 else float("nan")})
        if extra:
            r.update(extra)
        rows.append(r)
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(rows))


@query("cox_multivariate")
def cox_multivariate(spark, sf):
    """Rows 59/60: multivariate Cox (Efron ties) with summary columns."""
    ev = standardised_events(spark, sf).persist()
    r = cox.CoxFitter(ties="efron", alpha=0.0).fit(ev, EV_FEATURES)
    return _coef_frame(spark, EV_FEATURES, r.beta[0], r.se()[0])


@query("cox_lrt")
def cox_lrt(spark, sf):
    """Row 47: likelihood-ratio test of the multivariate model."""
    ev = standardised_events(spark, sf).persist()
    r = cox.CoxFitter(ties="efron").fit(ev, EV_FEATURES)
    t = cox.likelihood_ratio(r)
    return spark.createDataFrame([(t["statistic"], int(t["df"]), t["p"], t["neg_log2_p"])],
                                 "statistic double, df int, p double, neg_log2_p double")


@query("cox_fit_lines")
def cox_fit_lines(spark, sf):
    """Row 60: the reference default CoxPH (ridge alpha = 0.5, Breslow) on
    the large, heavily tied line-item view, plus its training Harrell C."""
    li = standardised_lines(spark, sf).persist()
    r = cox.CoxFitter(ties="breslow", alpha=0.5).fit(li, LINE_FEATURES)
    lp = None
    for j, f in enumerate(LINE_FEATURES):
        t = F.col(f) * F.lit(float(r.beta[0, j]))
        lp = t if lp is None else lp + t
    c = metrics.harrell_c(li, lp)["cindex"]
    return _coef_frame(spark, LINE_FEATURES, r.beta[0], r.se()[0], {"train_cindex": c})


@query("coxnet_path")
def coxnet_path(spark, sf):
    """Row 61: elastic-net path (100 alphas, l1_ratio 0.2, ratio 1e-4)."""
    ev = standardised_events(spark, sf).persist()
    path = coxnet.fit_path(ev, EV_FEATURES, l1_ratio=0.2, n_alphas=100, alpha_min_ratio=1e-4)
    return spark.createDataFrame(path.table())


@query("coxnet_pick")
def coxnet_pick(spark, sf):
    """Row 62: coefficients at the chosen alpha (last = reference default);
    the alphas of max deviance ratio and of max C reported alongside."""
    ev = standardised_events(spark, sf).persist()
    path = coxnet.fit_path(ev, EV_FEATURES, l1_ratio=0.2, n_alphas=100, alpha_min_ratio=1e-4, with_cindex=True)
    i, j, k = (coxnet.pick(path, how) for how in ("last", "deviance", "concordance"))
    return _coef_frame(spark, EV_FEATURES, path.coefs[i],
                       extra={"alpha": float(path.alphas[i]), "best_deviance_alpha": float(path.alphas[j]),
                              "best_c_alpha": float(path.alphas[k]), "best_c": float(path.cindex[k]),
                              "kkt_residual": float(path.kkt_residual().max()), "converged": bool(path.converged.all())})


def _svm_query(spark, sf, **kw):
    ev = standardised_events(spark, sf).persist()
    r = svm.fit_rank_svm(ev, EV_FEATURES, **kw)
    lp = None
    for j, f in enumerate(EV_FEATURES):
        t = F.col(f) * F.lit(float(r.coef[j]))
        lp = t if lp is None else lp + t
    c = metrics.harrell_c(ev, lp)["cindex"]
    return _coef_frame(spark, EV_FEATURES, r.coef, extra={"objective": float(r.objective), "train_cindex": c,
                                                         "converged": r.converged, "intercept": r.intercept})


# Fixed coefficients at which the SVM's sums are compared with a join of all pairs.
PAIR_BETA = {"value": 0.02, "k": -0.005, "hour": 0.03, "is_click": 0.4, "is_view": -0.3}
PAIR_LP = " + ".join(f"{c} * {b}" for c, b in PAIR_BETA.items())
PAIR_GRADS = ", ".join(f"round(sum(2 * m * (b_{c} - a_{c})) / count(*), 6) AS grad_{c}" for c in PAIR_BETA)
PAIR_COLS = ", ".join(f"{side}.{c} AS {side}_{c}" for side in "ab" for c in PAIR_BETA)
PAIR_SQL = f"""
WITH s AS (SELECT time, event, {", ".join(PAIR_BETA)}, {PAIR_LP} AS s FROM surv_events
           WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PAIR_BETA)}),
m AS (SELECT CAST(0 AS DOUBLE) AS margin UNION ALL SELECT 0.5),
p AS (SELECT margin, 1 - a.s + b.s AS m, {PAIR_COLS}
      FROM s a JOIN s b ON b.time > a.time OR (b.time = a.time AND b.event = 0) JOIN m ON b.s > a.s - 1 + margin
      WHERE a.event = 1)
SELECT margin, CAST(count(*) AS DOUBLE) AS active_pairs, round(sum(m) / count(*), 6) AS mean_margin,
       round(sum(m * m) / count(*), 6) AS mean_square, {PAIR_GRADS},
       round(sum(2 * (a_value - b_value) * (a_hour - b_hour)) / count(*), 6) AS hess_value_hour
FROM p GROUP BY margin
"""


@query("svm_pair_sums", V.with_views(PAIR_SQL, "surv_events"))
def svm_pair_sums(spark, sf):
    """Rows 63-66, 72: active pairs, loss, gradient and one entry of the Hessian a pair at fixed
    coefficients, for margins 0 and 0.5: the sums that every SVM fit takes."""
    names = list(PAIR_BETA)
    stats = svm.PairStats(svm._prepare(V.surv_events(spark, sf), names, "time", "event"), len(names))
    margins, beta = [0.0, 0.5], list(PAIR_BETA.values())
    rows = []
    for margin, r in zip(margins, stats.at([(beta, m, 0.0) for m in margins]), strict=True):
        n = r.count
        rows.append({"margin": margin, "active_pairs": float(n), "mean_margin": r.linear / n, "mean_square": r.square / n,
                     **{f"grad_{c}": float(g) / n for c, g in zip(names, r.square_grad, strict=True)},
                     "hess_value_hour": float(r.square_hess[names.index("value"), names.index("hour")]) / n})
    stats.close()
    schema = ", ".join(f"{c} double" for c in rows[0])
    got = spark.createDataFrame([tuple(float(v) for v in r.values()) for r in rows], schema)
    return got.select("margin", "active_pairs", *[r6(c, c) for c in got.columns[2:]])


@query("svm_pairwise")
def svm_pairwise(spark, sf):
    """Row 63 (NSVM): squared hinge, L2, C = 1 (alpha = 2C in our scaling)."""
    return _svm_query(spark, sf, alpha=2.0, loss="squared_hinge", penalty="l2")


@query("svm_pairwise_l1")
def svm_pairwise_l1(spark, sf):
    """Row 64 (NSVMl1): squared hinge with an L1 penalty."""
    return _svm_query(spark, sf, alpha=2.0, loss="squared_hinge", penalty="l1")


@query("svm_rank")
def svm_rank(spark, sf):
    """Row 65 (FSVM): ranking objective, alpha = 1, rank_ratio = 1."""
    return _svm_query(spark, sf, alpha=1.0, loss="squared_hinge", penalty="l2")


@query("svm_mixed")
def svm_mixed(spark, sf):
    """Row 65 (FSVM): half ranking, half regression of log time, with an intercept."""
    return _svm_query(spark, sf, alpha=1.0, rank_ratio=0.5, fit_intercept=True)


@query("svm_regression")
def svm_regression(spark, sf):
    """Row 65 (FSVM): rank_ratio 0, the regression of log time with one-sided residuals of censored rows."""
    return _svm_query(spark, sf, alpha=1.0, rank_ratio=0.0, fit_intercept=True)


@query("svm_hinge")
def svm_hinge(spark, sf):
    """Row 72 (HLSVM): pairwise hinge loss."""
    return _svm_query(spark, sf, alpha=2.0, loss="hinge", penalty="l2")


@query("svm_rff")
def svm_rff(spark, sf):
    """Row 66 (FKSVM, rbf): random Fourier features + the ranking SVM."""
    ev = standardised_events(spark, sf)
    mapped, cols = svm.feature_map(ev, EV_FEATURES, "rbf", n_components=16)
    mapped = mapped.persist()
    r = svm.fit_rank_svm(mapped, cols, alpha=1.0)
    lp = None
    for j, f in enumerate(cols):
        t = F.col(f) * F.lit(float(r.coef[j]))
        lp = t if lp is None else lp + t
    c = metrics.harrell_c(mapped, lp)["cindex"]
    return _coef_frame(spark, cols, r.coef, extra={"train_cindex": c})


@query("boost_componentwise")
def boost_componentwise(spark, sf):
    """Row 67 (CGBS): 100 steps, learning rate 0.1; final coefficients."""
    ev = standardised_events(spark, sf).persist()
    path = boost.componentwise(ev, EV_FEATURES, 100, 0.1)
    last = path[path["step"] == path["step"].max()]
    return spark.createDataFrame(last)


@query("boost_staged")
def boost_staged(spark, sf):
    """Row 70: staged risk scores after steps 10, 50, 100."""
    ev = standardised_events(spark, sf).persist()
    path = boost.componentwise(ev, EV_FEATURES, 100, 0.1)
    return boost.staged_scores(ev, path, [10, 50, 100], ["event_id"])


@query("boost_tree")
def boost_tree(spark, sf):
    """Rows 68-69 (GBS): depth-3 trees on the Cox gradient, 100 steps;
    final risk per row and the averaged importances."""
    ev = standardised_events(spark, sf)
    d, models = boost.trees(ev, EV_FEATURES, n_estimators=100, learning_rate=0.1, max_depth=3,
                            id_col="event_id")
    imp = boost.tree_importances(models)
    imps = F.create_map(*[x for j, f in enumerate(EV_FEATURES) for x in (F.lit(f), F.lit(float(imp[j])))])
    return d.select(F.col("id").alias("event_id"), F.col("F").alias("risk_score")).withColumn("importances", imps)
