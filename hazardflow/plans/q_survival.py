"""Registered queries: survival descriptive statistics, concordance, Cox."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cox, metrics, survival
from ..sources import views as V
from .registry import query, r6

# Fixed test parameters shared by both sides.
FIXED_BETA = {"value": 0.01, "k": -0.005, "is_click": 0.2, "hour": 0.003}
CURVE_GRID = [6.0, 12.0, 24.0, 36.0, 48.0, 60.0]


def _lp_col():
    out = None
    for c, b in FIXED_BETA.items():
        t = F.col(c) * F.lit(b)
        out = t if out is None else out + t
    return out


LP_SQL = " + ".join(f"{c} * {b}" for c, b in FIXED_BETA.items())


# -- Kaplan-Meier ------------------------------------------------------------
KM_SQL = """
WITH per AS (
  SELECT time, CAST(sum(event) AS DOUBLE) AS n_event, CAST(count(*) AS DOUBLE) AS n_rows
  FROM surv_events GROUP BY time),
r AS (
  SELECT *, n_rows - n_event AS n_censored,
         sum(n_rows) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_at_risk
  FROM per)
SELECT time, n_at_risk, n_event, n_censored,
       round(CASE WHEN sum(CASE WHEN n_event > 0 AND n_event >= n_at_risk THEN 1 ELSE 0 END) OVER w > 0
                  THEN 0.0
                  ELSE exp(sum(CASE WHEN n_event < n_at_risk
                                    THEN ln(greatest(1 - n_event / n_at_risk, 1e-300)) ELSE 0 END) OVER w)
             END, 6) AS survival
FROM r WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)
"""


@query("km_curve", V.with_views(KM_SQL, "surv_events"))
def km_curve(spark, sf):
    km = survival.kaplan_meier(V.surv_events(spark, sf))
    return km.select("time", "n_at_risk", "n_event", "n_censored", r6("survival", "survival"))


KM_GROUP_SQL = """
WITH per AS (
  SELECT event_type, time, CAST(sum(event) AS DOUBLE) AS n_event, CAST(count(*) AS DOUBLE) AS n_rows
  FROM surv_events GROUP BY event_type, time),
r AS (
  SELECT *, n_rows - n_event AS n_censored,
         sum(n_rows) OVER (PARTITION BY event_type ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_at_risk
  FROM per)
SELECT event_type, time, n_at_risk, n_event, n_censored,
       round(CASE WHEN sum(CASE WHEN n_event > 0 AND n_event >= n_at_risk THEN 1 ELSE 0 END) OVER w > 0
                  THEN 0.0
                  ELSE exp(sum(CASE WHEN n_event < n_at_risk
                                    THEN ln(greatest(1 - n_event / n_at_risk, 1e-300)) ELSE 0 END) OVER w)
             END, 6) AS survival
FROM r WINDOW w AS (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING)
"""


@query("km_by_group", V.with_views(KM_GROUP_SQL, "surv_events"))
def km_by_group(spark, sf):
    km = survival.kaplan_meier(V.surv_events(spark, sf), group="event_type")
    return km.select("event_type", "time", "n_at_risk", "n_event", "n_censored",
                     r6("survival", "survival"))


NA_SQL = """
WITH per AS (
  SELECT time, CAST(sum(event) AS DOUBLE) AS n_event, CAST(count(*) AS DOUBLE) AS n_rows
  FROM surv_lines GROUP BY time),
r AS (SELECT *, sum(n_rows) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_at_risk FROM per)
SELECT time, n_at_risk, n_event,
       round(sum(n_event / n_at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS cum_hazard
FROM r
"""


@query("nelson_aalen", V.with_views(NA_SQL, "surv_lines"))
def nelson_aalen(spark, sf):
    na = survival.nelson_aalen(V.surv_lines(spark, sf))
    return na.select("time", "n_at_risk", "n_event", r6("cum_hazard", "cum_hazard"))


# -- log-rank ------------------------------------------------------------------
LOGRANK_SQL = """
WITH per AS (
  SELECT time, CAST(sum(event) AS DOUBLE) AS d, CAST(sum(event * is_click) AS DOUBLE) AS d1,
         CAST(count(*) AS DOUBLE) AS m, CAST(sum(is_click) AS DOUBLE) AS m1
  FROM surv_events GROUP BY time),
r AS (SELECT *, sum(m) OVER w AS n, sum(m1) OVER w AS n1 FROM per
      WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT sum(d1) AS observed, sum(d * n1 / n) AS expected,
             sum(CASE WHEN n > 1 THEN n1 * (n - n1) * d * (n - d) / (n * n * (n - 1)) ELSE 0 END) AS variance
      FROM r)
SELECT round(observed, 6) AS observed, round(expected, 6) AS expected, round(variance, 6) AS variance,
       round((observed - expected) * (observed - expected) / variance, 6) AS statistic
FROM s
"""


@query("logrank_two_group", V.with_views(LOGRANK_SQL, "surv_events"))
def logrank_two_group(spark, sf):
    r = survival.logrank(V.surv_events(spark, sf), F.col("is_click") == 1)
    return spark.createDataFrame([(r["observed"], r["expected"], r["variance"], r["statistic"])],
                                 "observed double, expected double, variance double, statistic double") \
        .select(*[r6(c, c) for c in ["observed", "expected", "variance", "statistic"]])


CUT_QS = ", ".join(repr(float(q) / 100.0) for q in __import__("numpy").linspace(10, 90, 99))
CUT_SQL = f"""
WITH q AS (SELECT DISTINCT unnest(quantile_cont(value, [{CUT_QS}])) AS cut FROM surv_events),
c AS (SELECT CAST(row_number() OVER (ORDER BY cut) - 1 AS INTEGER) AS k, cut FROM q),
rows_k AS (
  SELECT c.k, c.cut, s.time, s.event, CASE WHEN s.value >= c.cut THEN 1 ELSE 0 END AS g
  FROM surv_events s, c WHERE s.value IS NOT NULL),
per AS (
  SELECT k, cut, time, CAST(sum(event) AS DOUBLE) AS d, CAST(sum(event * g) AS DOUBLE) AS d1,
         CAST(count(*) AS DOUBLE) AS m, CAST(sum(g) AS DOUBLE) AS m1
  FROM rows_k GROUP BY k, cut, time),
r AS (SELECT *, sum(m) OVER w AS n, sum(m1) OVER w AS n1 FROM per
      WINDOW w AS (PARTITION BY k ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT k, cut, sum(d1) AS observed, sum(d * n1 / n) AS expected,
             sum(CASE WHEN n > 1 THEN n1 * (n - n1) * d * (n - d) / (n * n * (n - 1)) ELSE 0 END) AS variance
      FROM r GROUP BY k, cut)
SELECT k, round(cut, 6) AS cut, round(observed, 6) AS observed, round(expected, 6) AS expected,
       round(variance, 6) AS variance,
       round((observed - expected) * (observed - expected) / variance, 6) AS statistic
FROM s
"""


@query("cutpoint_scan", V.with_views(CUT_SQL, "surv_events"))
def cutpoint_scan(spark, sf):
    res = survival.cutpoint_scan(V.surv_events(spark, sf), "value")
    return res.select("k", *[r6(c, c) for c in ["cut", "observed", "expected", "variance", "statistic"]])


# -- baseline hazard and curves (fixed beta) -------------------------------
BASE_SQL = f"""
WITH per AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, sum(exp({LP_SQL})) AS w
             FROM surv_events GROUP BY time),
r AS (SELECT *, sum(w) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS risk FROM per),
h AS (SELECT *, sum(d / risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS H FROM r)
SELECT time, d, round(risk, 6) AS risk, round(H, 6) AS cum_baseline_hazard,
       round(exp(-H), 6) AS baseline_survival
FROM h
"""


@query("baseline_hazard", V.with_views(BASE_SQL, "surv_events"))
def baseline_hazard(spark, sf):
    b = survival.baseline_hazard(V.surv_events(spark, sf), _lp_col())
    return b.select("time", "d", r6("risk", "risk"), r6("cum_baseline_hazard", "cum_baseline_hazard"),
                    r6("baseline_survival", "baseline_survival"))


GRID_SQL = ", ".join(f"({g})" for g in CURVE_GRID)
CURVE_SQL = f"""
WITH per AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, sum(exp({LP_SQL})) AS w
             FROM surv_events GROUP BY time),
r AS (SELECT *, sum(w) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS risk FROM per),
grid AS (SELECT * FROM (VALUES {GRID_SQL}) g(grid_time)),
hg AS (SELECT grid_time, coalesce(sum(CASE WHEN time <= grid_time THEN d / risk END), 0) AS H
       FROM grid, r GROUP BY grid_time)
SELECT s.event_id, hg.grid_time, round(exp(-hg.H * exp({LP_SQL})), 6) AS survival,
       round(hg.H * exp({LP_SQL}), 6) AS cum_hazard
FROM surv_events s, hg
"""


@query("survival_curves", V.with_views(CURVE_SQL, "surv_events"))
def survival_curves(spark, sf):
    ev = V.surv_events(spark, sf).persist()
    b = survival.baseline_hazard(ev, _lp_col())
    c = survival.survival_curves(ev, _lp_col(), b, CURVE_GRID, ["event_id"])
    return c.select("event_id", "grid_time", r6("survival", "survival"), r6("cum_hazard", "cum_hazard"))


# -- concordance ---------------------------------------------------------------
CIDX_SQL = f"""
WITH s AS (SELECT time, event, {LP_SQL} AS score FROM surv_events),
p AS (
  SELECT a.score AS si, b.score AS sj FROM s a JOIN s b ON b.time > a.time WHERE a.event = 1
  UNION ALL
  SELECT a.score, b.score FROM s a JOIN s b ON b.time = a.time WHERE a.event = 1 AND b.event = 0)
SELECT round(sum(CASE WHEN sj < si THEN 1.0 WHEN sj = si THEN 0.5 ELSE 0.0 END) / count(*), 6) AS cindex,
       CAST(count(*) AS DOUBLE) AS comparable
FROM p
"""


@query("c_index", V.with_views(CIDX_SQL, "surv_events"))
def c_index(spark, sf):
    r = metrics.harrell_c(V.surv_events(spark, sf), _lp_col())
    return spark.createDataFrame([(r["cindex"], r["comparable"])], "cindex double, comparable double") \
        .select(r6("cindex", "cindex"), "comparable")


G_SQL = """
g0 AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS m FROM {src} GROUP BY time),
g1 AS (SELECT *, sum(m) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n FROM g0),
g AS (SELECT time, CASE WHEN sum(CASE WHEN m - d > 0 AND m - d >= n - d THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
                   ELSE exp(sum(CASE WHEN m - d > 0 AND m - d < n - d
                                     THEN ln(1 - (m - d) / (n - d)) ELSE 0 END) OVER w) END AS G
      FROM g1 WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING))
"""

UNO_SQL = f"""
WITH {G_SQL.format(src='surv_events')},
s AS (SELECT e.time, e.event, {LP_SQL} AS score, 1.0 / (g.G * g.G) AS w
      FROM surv_events e JOIN g USING (time)),
p AS (
  SELECT a.w, a.score AS si, b.score AS sj FROM s a JOIN s b ON b.time > a.time WHERE a.event = 1
  UNION ALL
  SELECT a.w, a.score, b.score FROM s a JOIN s b ON b.time = a.time WHERE a.event = 1 AND b.event = 0)
SELECT round(sum(w * CASE WHEN sj < si THEN 1.0 WHEN sj = si THEN 0.5 ELSE 0.0 END) / sum(w), 6) AS cindex
FROM p
"""


@query("uno_c", V.with_views(UNO_SQL, "surv_events"))
def uno_c(spark, sf):
    r = metrics.uno_c(V.surv_events(spark, sf), _lp_col())
    return spark.createDataFrame([(r["cindex"],)], "cindex double").select(r6("cindex", "cindex"))


AUC_QS = ", ".join(repr(float(q) / 100.0) for q in __import__("numpy").linspace(5, 95, 99))
AUC_CORE = f"""
WITH {G_SQL.format(src='surv_events')},
taus AS (SELECT * FROM (SELECT DISTINCT unnest(quantile_cont(time, [{AUC_QS}])) AS tau FROM surv_events)
         WHERE tau < (SELECT max(time) FROM surv_events)),
tk AS (SELECT CAST(row_number() OVER (ORDER BY tau) - 1 AS INTEGER) AS k, tau FROM taus),
s AS (SELECT e.time, e.event, {LP_SQL} AS score, g.G FROM surv_events e JOIN g USING (time)),
x AS (SELECT tk.k, tk.tau, s.score,
             CASE WHEN s.event = 1 AND s.time <= tk.tau THEN 1.0 / s.G ELSE 0.0 END AS W,
             CASE WHEN s.time > tk.tau THEN 1.0 ELSE 0.0 END AS C
      FROM s, tk),
red AS (SELECT k, tau, score, sum(W) AS W, sum(C) AS C FROM x GROUP BY k, tau, score),
cum AS (SELECT *, coalesce(sum(C) OVER (PARTITION BY k ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Cless FROM red),
auc AS (SELECT k, tau, sum(W * (Cless + 0.5 * C)) / (sum(W) * sum(C)) AS auc FROM cum GROUP BY k, tau)
"""

DYN_AUC_SQL = AUC_CORE + "SELECT k, round(tau, 6) AS time, round(auc, 6) AS auc FROM auc"

KM_AT_SQL = """,
kp AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS m FROM surv_events GROUP BY time),
kr AS (SELECT *, sum(m) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n FROM kp),
km AS (SELECT time, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END)
                        OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)) AS S FROM kr),
st AS (SELECT auc.k, auc.auc, coalesce((SELECT S FROM km WHERE km.time <= auc.tau ORDER BY km.time DESC LIMIT 1), 1.0) AS S
       FROM auc),
sp AS (SELECT *, coalesce(lag(S) OVER (ORDER BY k), 1.0) AS prev FROM st)
SELECT round(sum(auc * (prev - S)) / (1 - min_by(S, -k)), 6) AS mean_auc FROM sp
"""
DYN_AUC_MEAN_SQL = AUC_CORE + KM_AT_SQL


@query("dynamic_auc", V.with_views(DYN_AUC_SQL, "surv_events"))
def dynamic_auc(spark, sf):
    ev = V.surv_events(spark, sf).persist()
    auc, _ = metrics.dynamic_auc(ev, _lp_col(), metrics.time_grid(ev))
    return auc.select(F.col("k").cast("int").alias("k"), r6("time", "time"), r6("auc", "auc"))


@query("dynamic_auc_mean", V.with_views(DYN_AUC_MEAN_SQL, "surv_events"))
def dynamic_auc_mean(spark, sf):
    ev = V.surv_events(spark, sf).persist()
    _, mean = metrics.dynamic_auc(ev, _lp_col(), metrics.time_grid(ev))
    return mean.select(r6("mean_auc", "mean_auc"))


# -- Cox -------------------------------------------------------------------------
UNI_FEATURES = ["value", "k", "hour", "is_click", "is_view"]


def _unrolled_newton_sql(features: list[str], steps: int = 6) -> str:
    unp = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, time, event, CAST({f} AS DOUBLE) AS x FROM surv_events" for f in features)
    parts = [f"u AS ({unp})", "b0 AS (SELECT DISTINCT feature, 0.0 AS b FROM u)"]

    def it(i):
        return (f"i{i} AS (SELECT u.feature, u.event, u.x, b{i}.b,"
                f" sum(exp(b{i}.b * u.x)) OVER w AS S0, sum(exp(b{i}.b * u.x) * u.x) OVER w AS S1,"
                f" sum(exp(b{i}.b * u.x) * u.x * u.x) OVER w AS S2"
                f" FROM u JOIN b{i} USING (feature)"
                f" WINDOW w AS (PARTITION BY u.feature ORDER BY u.time DESC"
                f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),"
                f" s{i} AS (SELECT feature, max(b) AS b,"
                f" sum(CASE WHEN event = 1 THEN x - S1 / S0 END) AS U,"
                f" sum(CASE WHEN event = 1 THEN S2 / S0 - (S1 / S0) * (S1 / S0) END) AS I"
                f" FROM i{i} GROUP BY feature)")
    for i in range(steps):
        parts.append(it(i))
        parts.append(f"b{i + 1} AS (SELECT feature, b + U / I AS b FROM s{i})")
    parts.append(it(steps))
    body = "WITH " + ",\n".join(parts)
    body += f"""
SELECT feature, round(b, 6) AS coef, round(exp(b), 6) AS exp_coef, round(1 / sqrt(I), 6) AS se_coef,
       round(b * sqrt(I), 6) AS z,
       round(b - 1.959963984540054 / sqrt(I), 6) AS coef_lower_95,
       round(b + 1.959963984540054 / sqrt(I), 6) AS coef_upper_95
FROM s{steps}"""
    return body


@query("cox_univariate", V.with_views(_unrolled_newton_sql(UNI_FEATURES), "surv_events"))
def cox_univariate(spark, sf):
    tab = cox.univariate_cox(V.surv_events(spark, sf), UNI_FEATURES, with_cindex=False)
    sdf = spark.createDataFrame(tab[["feature", "coef", "exp_coef", "se_coef", "z",
                                     "coef_lower_95", "coef_upper_95"]])
    return sdf.select("feature", *[r6(c, c) for c in ["coef", "exp_coef", "se_coef", "z",
                                                      "coef_lower_95", "coef_upper_95"]])


@query("cox_univariate_full")
def cox_univariate_full(spark, sf):
    """Row 46: all seven features with C-index, p and -log2 p."""
    features = [*UNI_FEATURES, "is_signup", "is_purchase"]
    return spark.createDataFrame(cox.univariate_cox(V.surv_events(spark, sf), features))


SCORE_FEATURES = ["l_discount", "l_tax", "p_size"]


def _score_test_sql() -> str:
    # Breslow score statistic at beta = 0 with tied times (surv_lines).
    xs = SCORE_FEATURES
    s1 = ", ".join(f"sum(CAST({x} AS DOUBLE)) AS m{i}" for i, x in enumerate(xs))
    s2 = ", ".join(f"sum(CAST({a} AS DOUBLE) * {b}) AS m{i}_{j}"
                   for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i)
    ev = ", ".join(f"sum(CASE WHEN event = 1 THEN CAST({x} AS DOUBLE) ELSE 0 END) AS e{i}" for i, x in enumerate(xs))
    cum = ", ".join([f"sum(m{i}) OVER w AS S{i}" for i in range(len(xs))]
                    + [f"sum(m{i}_{j}) OVER w AS S{i}_{j}" for i in range(len(xs)) for j in range(len(xs)) if j >= i])
    U = ", ".join(f"sum(e{i} - d * S{i} / n) AS U{i}" for i in range(len(xs)))
    I = ", ".join(f"sum(d * (S{i}_{j} / n - S{i} * S{j} / (n * n))) AS I{i}_{j}"
                  for i in range(len(xs)) for j in range(len(xs)) if j >= i)
    return f"""
WITH per AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS c, {s1}, {s2}, {ev}
             FROM surv_lines GROUP BY time),
r AS (SELECT *, sum(c) OVER w AS n, {cum} FROM per WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT {U}, {I} FROM r)
SELECT {", ".join(f"round(U{i}, 6) AS U{i}" for i in range(len(xs)))},
       {", ".join(f"round(I{i}_{j}, 3) AS I{i}_{j}" for i in range(len(xs)) for j in range(len(xs)) if j >= i)}
FROM t"""


@query("cox_score_test", V.with_views(_score_test_sql(), "surv_lines"))
def cox_score_test(spark, sf):
    r = cox.score_test(V.surv_lines(spark, sf), SCORE_FEATURES, ties="breslow")
    p = len(SCORE_FEATURES)
    vals = [float(r["U"][i]) for i in range(p)]
    names = [f"U{i}" for i in range(p)]
    for i in range(p):
        for j in range(i, p):
            vals.append(float(r["information"][i, j]))
            names.append(f"I{i}_{j}")
    sdf = spark.createDataFrame([tuple(vals)], ", ".join(f"{n} double" for n in names))
    # information entries are O(1e6): compared at 3 decimals
    return sdf.select(*[r6(n, n) if n.startswith("U") else F.round(n, 3).alias(n) for n in names])
