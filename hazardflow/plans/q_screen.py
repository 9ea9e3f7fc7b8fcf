"""Registered queries: univariate screens, vote, paths, PCA."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import describe, screen
from ..sources import views as V
from .registry import query, r6

SCREEN = ["value", "k", "hour", "is_click", "is_view"]
KENDALL = ["value", "k", "hour"]
CHI2 = ["k", "hour", "is_click", "is_view"]
#: Every numeric feature of surv_events.
EVERY = ["value", "k", "hour", "is_click", "is_view", "is_signup", "is_purchase"]


def _u(cols, src="surv_events", y="time"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, event FROM {src}"
        for c in cols)


VAR_SQL = f"""
WITH u AS ({_u(SCREEN)})
SELECT feature, round(var_pop(x), 6) AS variance, var_pop(x) > 0.16000000000000003 AS selected
FROM u GROUP BY feature
"""


@query("variance_select", V.with_views(VAR_SQL, "surv_events"))
def variance_select(spark, sf):
    v = screen.variance_select(V.surv_events(spark, sf), SCREEN)
    return v.select("feature", r6("variance", "variance"), "selected")


FSEL_SQL = f"""
WITH u AS ({_u(SCREEN)})
SELECT feature, count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope,
       round(regr_r2(y, x), 6) AS r2,
       round(corr(x, y) * corr(x, y) * (count(*) - 2) / (1 - corr(x, y) * corr(x, y)), 6) AS f
FROM u GROUP BY feature
"""


@query("f_select", V.with_views(FSEL_SQL, "surv_events"))
def f_select(spark, sf):
    s = screen.correlation_stats(V.surv_events(spark, sf), SCREEN, "time")
    return s.select("feature", "n", *[r6(c, c) for c in ["r", "slope", "r2", "f"]])


SPM_SQL = f"""
WITH u AS ({_u(SCREEN)}),
rk AS (SELECT feature,
              rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
       FROM u)
SELECT feature, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY feature
"""


@query("spearman", V.with_views(SPM_SQL, "surv_events"))
def spearman(spark, sf):
    return screen.spearman(V.surv_events(spark, sf), SCREEN, "time").select("feature", "n", r6("rho", "rho"))


KDT_SQL = f"""
WITH u AS (SELECT feature, x, y, row_number() OVER (PARTITION BY feature ORDER BY x, y) AS rid
           FROM ({_u(KENDALL)})),
s AS (SELECT a.feature, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s
      FROM u a JOIN u b ON a.feature = b.feature AND a.rid < b.rid GROUP BY a.feature),
n AS (SELECT feature, count(*) AS n FROM u GROUP BY feature),
tx AS (SELECT feature, sum(c * (c - 1) / 2) AS t FROM (SELECT feature, x, count(*) AS c FROM u GROUP BY ALL) GROUP BY feature),
ty AS (SELECT feature, sum(c * (c - 1) / 2) AS t FROM (SELECT feature, y, count(*) AS c FROM u GROUP BY ALL) GROUP BY feature)
SELECT s.feature, round(s.s / sqrt((n.n * (n.n - 1) / 2 - tx.t) * (n.n * (n.n - 1) / 2 - ty.t)), 6) AS tau
FROM s JOIN n USING (feature) JOIN tx USING (feature) JOIN ty USING (feature)
"""


@query("kendall", V.with_views(KDT_SQL, "surv_events"))
def kendall(spark, sf):
    ev = V.surv_events(spark, sf).persist()
    t = screen.kendall(ev, KENDALL, "time")
    return spark.createDataFrame(t[["feature", "tau"]]).select("feature", r6("tau", "tau"))


MI_QS = ", ".join(repr(i / 10) for i in range(1, 10))
MI_SQL = f"""
WITH u AS ({_u(SCREEN)}),
cx AS (SELECT feature, quantile_cont(x, [{MI_QS}]) AS cuts FROM u GROUP BY feature),
cy AS (SELECT quantile_cont(time, [{MI_QS}]) AS ycuts FROM surv_events),
b AS (SELECT u.feature, len(list_filter(cx.cuts, lambda c: c <= u.x)) AS binx, len(list_filter(cy.ycuts, lambda c: c <= u.y)) AS biny
      FROM u JOIN cx USING (feature), cy),
j AS (SELECT feature, binx, biny, CAST(count(*) AS DOUBLE) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, binx) AS nx,
             sum(nxy) OVER (PARTITION BY feature, biny) AS ny FROM j)
SELECT feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM m GROUP BY feature
"""


@query("mi_binned", V.with_views(MI_SQL, "surv_events"))
def mi_binned(spark, sf):
    return screen.mi_binned(V.surv_events(spark, sf), SCREEN, "time").select("feature", r6("mi", "mi"))


K_TOP = int(round(0.8 * len(SCREEN)))
VOTE_SQL = f"""
WITH u AS ({_u(SCREEN)}),
c AS (SELECT feature, var_pop(x) AS v, corr(x, y) AS r,
             corr(x, y) * corr(x, y) * (count(*) - 2) / (1 - corr(x, y) * corr(x, y)) AS f FROM u GROUP BY feature),
rk AS (SELECT feature,
              rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
       FROM u),
sp AS (SELECT feature, corr(rx, ry) AS rho FROM rk GROUP BY feature),
sc AS (SELECT 'ANVF' AS method, feature, f AS score, NULL AS selected FROM c
       UNION ALL SELECT 'PEAS', feature, abs(r), NULL FROM c
       UNION ALL SELECT 'LR', feature, abs(r), NULL FROM c
       UNION ALL SELECT 'SPM', feature, abs(rho), NULL FROM sp
       UNION ALL SELECT 'VTh', feature, v, v > 0.16000000000000003 FROM c),
rkd AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC NULLS LAST, feature) AS rn FROM sc)
SELECT feature, round(avg(CAST(coalesce(selected, rn <= {K_TOP}) AS DOUBLE)), 6) AS true_ratio,
       avg(CAST(coalesce(selected, rn <= {K_TOP}) AS DOUBLE)) >= 0.15 AS kept
FROM rkd GROUP BY feature
"""


@query("topk_vote", V.with_views(VOTE_SQL, "surv_events"))
def topk_vote(spark, sf):
    ev = V.surv_events(spark, sf).persist()
    c = screen.correlation_stats(ev, SCREEN, "time")
    sp = screen.spearman(ev, SCREEN, "time")
    var = screen.variance_select(ev, SCREEN)
    sel = F.lit(None).cast("boolean")
    scores = (c.select(F.lit("ANVF").alias("method"), "feature", F.col("f").alias("score"), sel.alias("selected"))
              .unionByName(c.select(F.lit("PEAS").alias("method"), "feature", F.abs("r").alias("score"), sel.alias("selected")))
              .unionByName(c.select(F.lit("LR").alias("method"), "feature", F.abs("r").alias("score"), sel.alias("selected")))
              .unionByName(sp.select(F.lit("SPM").alias("method"), "feature", F.abs("rho").alias("score"), sel.alias("selected")))
              .unionByName(var.select(F.lit("VTh").alias("method"), "feature", F.col("variance").alias("score"), "selected")))
    v = screen.top_k_vote(scores, K_TOP, 0.15)
    return v.select("feature", r6("true_ratio", "true_ratio"), "kept")


K_FULL = int(round(0.8 * len(EVERY)))
FULL_VOTE_SQL = f"""
WITH kd AS ({KDT_SQL.replace(_u(KENDALL), _u(EVERY))}),
mi AS ({MI_SQL.replace(_u(SCREEN), _u(EVERY))}),
{VOTE_SQL.strip().removeprefix("WITH ").replace(_u(SCREEN), _u(EVERY)).replace(f"rn <= {K_TOP}", f"rn <= {K_FULL}").replace(
    "       UNION ALL SELECT 'VTh'", """       UNION ALL SELECT 'KDT', feature, abs(tau), NULL FROM kd
       UNION ALL SELECT 'MI', feature, mi, NULL FROM mi
       UNION ALL SELECT 'VTh'""")}
"""


@query("topk_vote_full", V.with_views(FULL_VOTE_SQL, "surv_events"))
def topk_vote_full(spark, sf):
    """Rows 49-50: the vote of all seven methods over all seven features."""
    ev = V.surv_events(spark, sf).persist()
    c = screen.correlation_stats(ev, EVERY, "time")
    kd = spark.createDataFrame(screen.kendall(ev, EVERY, "time")[["feature", "tau"]])
    sel = F.lit(None).cast("boolean")

    def method(name, frame, score):
        return frame.select(F.lit(name).alias("method"), "feature", score.alias("score"), sel.alias("selected"))

    var = screen.variance_select(ev, EVERY)
    scores = (method("ANVF", c, F.col("f")).unionByName(method("PEAS", c, F.abs("r")))
              .unionByName(method("LR", c, F.abs("r")))
              .unionByName(method("SPM", screen.spearman(ev, EVERY, "time"), F.abs("rho")))
              .unionByName(method("KDT", kd, F.abs("tau")))
              .unionByName(method("MI", screen.mi_binned(ev, EVERY, "time"), F.col("mi")))
              .unionByName(var.select(F.lit("VTh").alias("method"), "feature", F.col("variance").alias("score"), "selected")))
    v = screen.top_k_vote(scores, K_FULL, 0.15)
    return v.select("feature", r6("true_ratio", "true_ratio"), "kept")


TWO_SQL = f"""
WITH u AS ({_u(SCREEN)}),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx
       FROM u),
a AS (SELECT feature, CAST(sum(CASE WHEN event > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
             CAST(sum(CASE WHEN event > 0 THEN 0 ELSE 1 END) AS DOUBLE) AS n2,
             sum(CASE WHEN event > 0 THEN rx ELSE 0 END) AS r1,
             avg(CASE WHEN event > 0 THEN x END) AS m1, avg(CASE WHEN event > 0 THEN NULL ELSE x END) AS m2,
             var_samp(CASE WHEN event > 0 THEN x END) AS v1, var_samp(CASE WHEN event > 0 THEN NULL ELSE x END) AS v2
      FROM rk GROUP BY feature)
SELECT feature, n1, n2, round(r1, 6) AS rank_sum, round(r1 - n1 * (n1 + 1) / 2, 6) AS mwu,
       round((r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS ranksum_z,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch_t
FROM a
"""


@query("rank_sum_welch", V.with_views(TWO_SQL, "surv_events"))
def rank_sum_welch(spark, sf):
    t = screen.two_sample(V.surv_events(spark, sf), SCREEN, "event")
    return t.select("feature", "n1", "n2", *[r6(c, c) for c in ["rank_sum", "mwu", "ranksum_z", "welch_t"]])


CHI2_SQL = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, round((o1 - e1) * (o1 - e1) / e1 + (t - o1 - e0) * (t - o1 - e0) / e0, 6) AS chi2
FROM (SELECT sum({c}) AS t, sum(CASE WHEN event > 0 THEN {c} ELSE 0 END) AS o1,
             avg(CAST(event > 0 AS DOUBLE)) * sum({c}) AS e1, (1 - avg(CAST(event > 0 AS DOUBLE))) * sum({c}) AS e0
      FROM surv_events)""" for c in CHI2)


@query("chi2", V.with_views(CHI2_SQL, "surv_events"))
def chi2(spark, sf):
    return screen.chi2_scores(V.surv_events(spark, sf), CHI2, "event").select("feature", r6("chi2", "chi2"))


#: Mean of x * y as a mergeable accumulator of (sum, count).
_mean_product = screen.Statistic(update=lambda x, y: [float((x * y).sum()), float(len(x))],
                                 merge=lambda a, b: [a[0] + b[0], a[1] + b[1]],
                                 finish=lambda s: (s[0] / s[1], float("nan")))


CUSTOM_SQL = f"""
WITH u AS ({_u(SCREEN)})
SELECT feature, round(avg(x * y), 6) AS score FROM u GROUP BY feature
"""


@query("custom_stat", V.with_views(CUSTOM_SQL, "surv_events"))
def custom_stat(spark, sf):
    return screen.custom_stat(V.surv_events(spark, sf), SCREEN, "time", _mean_product) \
        .select("feature", r6("score", "score"))


def _normal_p(z: str) -> str:
    """Two-sided normal p of the SQL value ``z`` by Simpson's rule over 0..|z| (0 beyond 12)."""
    h = f"(abs({z}) / 2000)"
    return f"""CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 12 THEN 0.0 ELSE 1 - 2 * {h} / 3 / sqrt(2 * pi())
      * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-0.5 * (i * {h}) * (i * {h})))) END"""


def _student_p(t: str, dof: str) -> str:
    """Two-sided Student p by Simpson's rule over 0..|t| (0 beyond 40; for the thousands of degrees of freedom here)."""
    h = f"(abs({t}) / 2000)"
    return f"""CASE WHEN {t} IS NULL THEN NULL WHEN abs({t}) > 40 THEN 0.0 ELSE 1 - 2 * {h} / 3
      * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi() * {dof})
      * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + (i * {h}) * (i * {h}) / {dof}, -({dof} + 1) / 2.0))) END"""


SCREEN_P_SQL = f"""
WITH u AS ({_u(EVERY)}),
c AS (SELECT feature, count(*) AS n, corr(x, y) AS r, regr_slope(y, x) AS slope FROM u GROUP BY feature),
rk AS (SELECT feature,
              rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
       FROM u),
sp AS (SELECT feature, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY feature),
s AS (SELECT 'ANVF' AS method, feature, n, r * r * (n - 2) / (1 - r * r) AS statistic, r FROM c
      UNION ALL SELECT 'PEAS', feature, n, r, r FROM c
      UNION ALL SELECT 'LR', feature, n, slope, r FROM c
      UNION ALL SELECT 'SPM', feature, n, r, r FROM sp),
t AS (SELECT method, feature, n, statistic, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS dof FROM s)
SELECT method, feature, n, round(statistic, 6) AS statistic, round({_student_p("t", "dof")}, 6) AS p FROM t
"""


@query("screen_pvalues", V.with_views(SCREEN_P_SQL, "surv_events"))
def screen_pvalues(spark, sf):
    s = screen.screen_pvalues(V.surv_events(spark, sf), EVERY, "time")
    return s.select("method", "feature", "n", r6("statistic", "statistic"), r6("p", "p"))


TWO_P_SQL = f"""
WITH u AS ({_u(SCREEN)}),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx
       FROM u),
a AS (SELECT feature, CAST(count(*) FILTER (event > 0) AS DOUBLE) AS n1, CAST(count(*) FILTER (event <= 0) AS DOUBLE) AS n2,
             sum(rx) FILTER (event > 0) AS r1, avg(x) FILTER (event > 0) AS m1, avg(x) FILTER (event <= 0) AS m2,
             var_samp(x) FILTER (event > 0) AS v1, var_samp(x) FILTER (event <= 0) AS v2 FROM rk GROUP BY feature),
t AS (SELECT feature, (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z,
             (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
             pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM a)
SELECT feature, round(z, 6) AS ranksum_z, round({_normal_p("z")}, 6) AS ranksum_p, round(t, 6) AS welch_t,
       round(dof, 6) AS welch_dof, round({_student_p("t", "dof")}, 6) AS welch_p FROM t
"""


@query("two_sample_pvalues", V.with_views(TWO_P_SQL, "surv_events"))
def two_sample_pvalues(spark, sf):
    t = screen.two_sample_pvalues(V.surv_events(spark, sf), SCREEN)
    return t.select("feature", *[r6(c, c) for c in ["ranksum_z", "ranksum_p", "welch_t", "welch_dof", "welch_p"]])


PAIRS = [("value", "hour"), ("hour", "k"), ("is_click", "is_view")]
_DIFFERENCES = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE) AS d FROM surv_events" for a, b in PAIRS)
SIGNED_SQL = f"""
WITH u AS (SELECT * FROM ({_DIFFERENCES}) WHERE d <> 0),
rk AS (SELECT a, b, d, count(*) OVER (PARTITION BY a, b, abs(d)) AS c,
              rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM u),
s AS (SELECT a, b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM rk GROUP BY a, b),
t AS (SELECT *, (w_plus - CAST(n AS DOUBLE) * (n + 1) / 4)
                / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
SELECT a, b, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z,
       round({_normal_p("z")}, 6) AS p FROM t
"""


@query("signed_rank", V.with_views(SIGNED_SQL, "surv_events"))
def signed_rank(spark, sf):
    t = screen.signed_rank(V.surv_events(spark, sf), PAIRS)
    return t.select("a", "b", "n", *[r6(c, c) for c in ["w_plus", "w_minus", "z", "p"]])


# -- regularisation paths and PCA ---------------------------------------------------
RIDGE = ["value", "k"]
RIDGE_SQL = f"""
WITH g AS (SELECT sum(value * value) AS a, sum(value * k) AS b, sum(k * k) AS c,
                  sum(value * time) AS u, sum(k * time) AS v FROM surv_events),
al AS (SELECT i, -4 + i * (10.0 / 99) AS la FROM range(100) t(i)),
w AS (SELECT i, la, pow(10, la) AS al, a, b, c, u, v FROM al, g)
SELECT CAST(i AS BIGINT) AS i, round(la, 6) AS log10_alpha, 'value' AS feature,
       round(((c + al) * u - b * v) / ((a + al) * (c + al) - b * b), 6) AS coef FROM w
UNION ALL
SELECT CAST(i AS BIGINT), round(la, 6), 'k', round(((a + al) * v - b * u) / ((a + al) * (c + al) - b * b), 6) FROM w
"""


@query("ridge_path", V.with_views(RIDGE_SQL, "surv_events"))
def ridge_path(spark, sf):
    p = describe.ridge_path(V.surv_events(spark, sf), RIDGE, "time")
    return spark.createDataFrame(p).select(F.col("i").cast("bigint").alias("i"), r6("log10_alpha", "log10_alpha"),
                                           "feature", r6("coef", "coef"))


@query("ridge_path_full")
def ridge_path_full(spark, sf):
    """Row 34: the ridge path over all seven features."""
    return spark.createDataFrame(describe.ridge_path(V.surv_events(spark, sf), EVERY, "time"))


@query("lasso_path")
def lasso_path(spark, sf):
    p = describe.lasso_path(V.surv_events(spark, sf), EVERY, "time")
    return spark.createDataFrame(p)


@query("pca_ratio")
def pca_ratio(spark, sf):
    cols = ["value", "k", "hour", "is_click", "is_view", "is_signup", "is_purchase"]
    m = describe.PCA(0.95).fit(V.surv_events(spark, sf), cols)
    rows = [(j, float(v), float(r)) for j, (v, r) in enumerate(zip(m.explained_variance, m.explained_ratio))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double")


@query("pca_scores")
def pca_scores(spark, sf):
    cols = ["value", "k", "hour", "is_click", "is_view", "is_signup", "is_purchase"]
    ev = V.surv_events(spark, sf)
    m = describe.PCA(0.95).fit(ev, cols)
    return ev.select("event_id", *[e.alias(c) for c, e in m.columns().items()], "time", "event")
