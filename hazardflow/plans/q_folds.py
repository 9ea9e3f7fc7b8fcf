"""Registered queries: splits and cross-fold aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, cox, splits
from ..sources import views as V
from .registry import query, r6

# -- splits ---------------------------------------------------------------------


def _h(seed_expr: str) -> str:
    return f"((event_id + 1) * ({splits.HASH_MUL} + ({seed_expr}))) % {splits.HASH_MOD}"


SSS_SQL = f"""
WITH d AS (SELECT event_id, event, CAST(s.split AS INTEGER) AS split, {_h('s.split * 1000 + 0')} AS h
           FROM surv_events, range(10) s(split)),
r AS (SELECT *, row_number() OVER (PARTITION BY split, event ORDER BY h, event_id) - 1 AS rk,
             count(*) OVER (PARTITION BY split, event) AS nc FROM d)
SELECT split, event_id, rk < round(nc * 0.25) AS is_test FROM r
"""


@query("split_sss", V.with_views(SSS_SQL, "surv_events"))
def split_sss(spark, sf):
    return splits.stratified_shuffle(V.surv_events(spark, sf), "event_id", "event", 10, 0.25, 0)


TEXT_ID = "'T12-' || CAST(event_id AS VARCHAR)"
SSS_TEXT_SQL = f"""
WITH d AS (SELECT {TEXT_ID} AS sample, event, CAST(s.split AS INTEGER) AS split,
                  CAST('0x' || substr(md5({TEXT_ID} || ':' || CAST(s.split * 1000 AS VARCHAR)), 1, 15) AS BIGINT) AS h
           FROM surv_events, range(10) s(split)),
r AS (SELECT *, row_number() OVER (PARTITION BY split, event ORDER BY h, sample) - 1 AS rk,
             count(*) OVER (PARTITION BY split, event) AS nc FROM d)
SELECT split, sample, rk < round(nc * 0.25) AS is_test FROM r
"""


@query("split_sss_text", V.with_views(SSS_TEXT_SQL, "surv_events"))
def split_sss_text(spark, sf):
    """Row 78 over a text sample id."""
    ev = V.surv_events(spark, sf).withColumn("sample", F.concat(F.lit("T12-"), F.col("event_id").cast("string")))
    return splits.stratified_shuffle(ev, "sample", "event", 10, 0.25, 0)


SKF_SQL = """
SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY event ORDER BY event_id) - 1) * 4
                            / count(*) OVER (PARTITION BY event)) AS INTEGER) AS fold
FROM surv_events
"""


@query("split_skf", V.with_views(SKF_SQL, "surv_events"))
def split_skf(spark, sf):
    return splits.stratified_kfold(V.surv_events(spark, sf), "event_id", "event", 4)


def _rkf_sql(stratified: bool) -> str:
    part = "repeat, event" if stratified else "repeat"
    return f"""
WITH d AS (SELECT event_id, event, CAST(s.r AS INTEGER) AS repeat, {_h('s.r * 1000 + 1')} AS h
           FROM surv_events, range(3) s(r))
SELECT repeat, event_id, CAST(floor((row_number() OVER (PARTITION BY {part} ORDER BY h, event_id) - 1) * 4
                                    / count(*) OVER (PARTITION BY {part})) AS INTEGER) AS fold
FROM d
"""


@query("split_rskf", V.with_views(_rkf_sql(True), "surv_events"))
def split_rskf(spark, sf):
    return splits.repeated_kfold(V.surv_events(spark, sf), "event_id", "event", 4, 3, 1)


@query("split_rkf", V.with_views(_rkf_sql(False), "surv_events"))
def split_rkf(spark, sf):
    return splits.repeated_kfold(V.surv_events(spark, sf), "event_id", None, 4, 3, 1)


LOO_SQL = "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS fold FROM surv_events"


@query("split_loo", V.with_views(LOO_SQL, "surv_events"))
def split_loo(spark, sf):
    return splits.leave_one_out(V.surv_events(spark, sf), "event_id")


SSA_SQL = f"""
WITH sss AS ({SSS_SQL}),
never AS (SELECT event_id FROM surv_events EXCEPT SELECT event_id FROM sss WHERE is_test),
skf AS ({SKF_SQL}),
extra AS (SELECT CAST(f.f + 10 AS INTEGER) AS split, event_id, fold = f.f AS is_test
          FROM skf, range(4) f(f) WHERE (SELECT count(*) FROM never) > 0)
SELECT * FROM sss UNION ALL SELECT * FROM extra
"""


@query("split_ssa", V.with_views(SSA_SQL, "surv_events"))
def split_ssa(spark, sf):
    return splits.ssa(V.surv_events(spark, sf), "event_id", "event", 10, 0.25, 0)


HOLD_SQL = """
WITH r AS (SELECT event_id, event, row_number() OVER (PARTITION BY event ORDER BY time, event, event_id) - 1 AS rk,
                  count(*) OVER (PARTITION BY event) AS n FROM surv_events),
sz AS (SELECT DISTINCT event, n, CAST(floor(n * 0.3) AS BIGINT) AS m FROM r),
pos AS (SELECT DISTINCT sz.event,
               CASE WHEN sz.m = 1 THEN 1
                    WHEN i.i = sz.m - 1 THEN sz.n - 2
                    ELSE CAST(floor(i.i * ((sz.n - 3) / (sz.m - 1)) + 1.0) AS BIGINT) END AS rk
        FROM sz, range(CAST((SELECT max(m) FROM sz) AS BIGINT)) i(i) WHERE i.i < sz.m)
SELECT r.event_id, pos.rk IS NOT NULL AS is_test FROM r LEFT JOIN pos ON r.event = pos.event AND r.rk = pos.rk
"""


@query("holdout_systematic", V.with_views(HOLD_SQL, "surv_events"))
def holdout_systematic(spark, sf):
    return splits.systematic_holdout(V.surv_events(spark, sf), "event_id", "time", "event", 0.3)


RAND_SQL = f"""
SELECT event_id, row_number() OVER (ORDER BY {_h('10')}, event_id) - 1 < ceil(count(*) OVER () * 0.3) AS is_test
FROM surv_events
"""


@query("holdout_random", V.with_views(RAND_SQL, "surv_events"))
def holdout_random(spark, sf):
    return splits.random_holdout(V.surv_events(spark, sf), "event_id", 0.3, 10)


# -- fold models: one-step univariate Cox estimates per RKF fold ------------------
FOLD_FEATURES = ["value", "k", "hour"]
GROUPS = {"value": "numeric", "k": "numeric", "hour": "clock"}


def fold_coefficients(spark, sf):
    """(fold, feature, coef): beta = U(0)/I(0) (Breslow) on each fold's
    training rows; fold = repeat * 4 + test fold of the RKF assignment.
    All (fold, feature) models take one pass over rows that carry the list of
    the folds they train: no row is copied for a fold or a feature."""
    ev = V.surv_events(spark, sf).persist()
    asg = splits.repeated_kfold(ev, "event_id", None, 4, 3, 1) \
        .select("event_id", "repeat", (F.col("repeat") * 4 + F.col("fold")).alias("test_fold"))
    # an id's assignments, one of each repeat side by side (an id that repeats has several)
    own = asg.groupBy("event_id").agg(*[F.collect_list(F.when(F.col("repeat") == r, F.col("test_fold"))).alias(f"t{r}")
                                        for r in range(3)])
    own = own.select("event_id", F.explode(F.arrays_zip("t0", "t1", "t2")).alias("t"))
    # training folds of a row: the other folds of the same repeat
    train_folds = F.flatten(F.transform(F.array("t.t0", "t.t1", "t.t2"), lambda test: F.filter(
        F.sequence(test - test % 4, test - test % 4 + 3), lambda f: f != test)))
    rows = ev.join(own, "event_id").select("time", "event", *FOLD_FEATURES, train_folds.alias("fold"))
    step = cox.one_step(rows, FOLD_FEATURES, "fold", univariate=True)
    out = [(int(fold), feature, float(b[0])) for (fold, feature), b in step.items()]
    return spark.createDataFrame(out, "fold int, feature string, coef double"), ev, asg


FOLD_CORE = f"""
WITH a AS (SELECT event_id, time, event, value, k, hour, s.r AS rep,
                  CAST((s.r * 4 + floor((row_number() OVER (PARTITION BY s.r ORDER BY {_h('s.r * 1000 + 1')}, event_id) - 1) * 4
                                / count(*) OVER (PARTITION BY s.r))) AS INTEGER) AS test_fold
           FROM surv_events, range(3) s(r)),
tr AS (SELECT f.f AS fold, a.* FROM a, range(12) f(f) WHERE f.f // 4 = a.rep AND a.test_fold <> f.f),
u AS ({" UNION ALL ".join(f"SELECT fold, '{c}' AS feature, time, event, CAST({c} AS DOUBLE) AS x FROM tr" for c in FOLD_FEATURES)}),
pt AS (SELECT fold, feature, time, CAST(sum(event) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS c,
              sum(x) AS sx, sum(x * x) AS sxx, sum(CASE WHEN event = 1 THEN x ELSE 0 END) AS ex
       FROM u GROUP BY ALL),
rs AS (SELECT *, sum(c) OVER w AS n, sum(sx) OVER w AS s1, sum(sxx) OVER w AS s2 FROM pt
       WINDOW w AS (PARTITION BY fold, feature ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
co AS (SELECT CAST(fold AS INTEGER) AS fold, feature,
              sum(ex - d * s1 / n) / sum(d * (s2 / n - (s1 / n) * (s1 / n))) AS coef
       FROM rs GROUP BY ALL)
"""

COEF_SUMMARY_SQL = FOLD_CORE + """
SELECT feature, round(avg(coef), 6) AS coef_mean, round(stddev_samp(coef), 6) AS coef_std,
       round(quantile_cont(coef, 0.5), 6) AS coef_median, round(avg(exp(coef)), 6) AS exp_coef_mean,
       round(stddev_samp(exp(coef)), 6) AS exp_coef_std, round(quantile_cont(exp(coef), 0.5), 6) AS exp_coef_median,
       round(exp(avg(coef)), 6) AS exp_coef_of_mean
FROM co GROUP BY feature
"""


@query("coef_summary", V.with_views(COEF_SUMMARY_SQL, "surv_events"))
def coef_summary(spark, sf):
    coefs, _, _ = fold_coefficients(spark, sf)
    s = aggregate.coef_summary(coefs)
    return s.select("feature", *[r6(c, c) for c in s.columns if c != "feature"])


def _lp_sql(alias: str = "") -> str:
    return " + ".join(f"{alias}{c} * max(CASE WHEN co.feature = '{c}' THEN co.coef END)" for c in FOLD_FEATURES)


RISK_FINAL_SQL = FOLD_CORE + f"""
, det AS (SELECT a.event_id, a.test_fold AS fold, {" + ".join(f"a.{c} * w.b_{c}" for c in FOLD_FEATURES)} AS risk
          FROM a JOIN (SELECT fold, {", ".join(f"max(CASE WHEN feature = '{c}' THEN coef END) AS b_{c}" for c in FOLD_FEATURES)}
                       FROM co GROUP BY fold) w ON a.test_fold = w.fold),
mc AS (SELECT {", ".join(f"avg(CASE WHEN feature = '{c}' THEN coef END) AS m_{c}" for c in FOLD_FEATURES)} FROM co),
ag AS (SELECT event_id, avg(risk) AS rmean, quantile_cont(risk, 0.5) AS rmed FROM det GROUP BY event_id)
SELECT s.event_id, s.time, s.event, round(ag.rmean, 6) AS risk_score_mean, round(ag.rmed, 6) AS risk_score_median,
       round({" + ".join(f"s.{c} * mc.m_{c}" for c in FOLD_FEATURES)}, 6) AS risk_score_coefs_mean,
       round(exp(ag.rmean), 6) AS exp_risk_score_mean, round(exp(ag.rmed), 6) AS exp_risk_score_median,
       round(exp({" + ".join(f"s.{c} * mc.m_{c}" for c in FOLD_FEATURES)}), 6) AS exp_risk_score_coefs_mean
FROM surv_events s JOIN ag USING (event_id), mc
"""


def fold_risk_detail(coefs, ev, asg):
    """Row 94: risk score of every test row under its fold's model."""
    wide = coefs.groupBy("fold").pivot("feature", FOLD_FEATURES).agg(F.first("coef"))
    t = ev.join(asg, "event_id").join(F.broadcast(wide.withColumnRenamed("fold", "test_fold")
                                                  .select("test_fold", *[F.col(c).alias(f"b_{c}") for c in FOLD_FEATURES])),
                                      "test_fold")
    risk = None
    for c in FOLD_FEATURES:
        term = F.col(c) * F.col(f"b_{c}")
        risk = term if risk is None else risk + term
    return t.select(F.col("test_fold").alias("fold"), "event_id", "time", "event", risk.alias("risk_score"))


@query("risk_final", V.with_views(RISK_FINAL_SQL, "surv_events"))
def risk_final(spark, sf):
    coefs, ev, asg = fold_coefficients(spark, sf)
    coefs = coefs.persist()
    det = fold_risk_detail(coefs, ev, asg)
    mean = {r["feature"]: r["m"] for r in coefs.groupBy("feature").agg(F.avg("coef").alias("m")).collect()}
    out = aggregate.risk_final(det, ev, "event_id", mean)
    return out.select("event_id", "time", "event", *[r6(c, c) for c in out.columns
                                                      if c not in ("event_id", "time", "event")])


GROUP_VALUES = ", ".join(f"('{f}', '{g}')" for f, g in GROUPS.items())
COEF_BOX_SQL = FOLD_CORE + f"""
, g AS (SELECT * FROM (VALUES {GROUP_VALUES}) t(feature, "group")),
j AS (SELECT g."group", co.feature, co.coef FROM co JOIN g USING (feature)),
q AS (SELECT "group", feature, quantile_cont(coef, 0.25) AS q1, quantile_cont(coef, 0.5) AS median,
             quantile_cont(coef, 0.75) AS q3, avg(coef) AS mean FROM j GROUP BY ALL)
SELECT q."group", q.feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean,
       CAST(sum(CASE WHEN coef < q1 - 1.5 * (q3 - q1) OR coef > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM j JOIN q USING ("group", feature) GROUP BY ALL
"""


@query("coef_box", V.with_views(COEF_BOX_SQL, "surv_events"))
def coef_box(spark, sf):
    coefs, _, _ = fold_coefficients(spark, sf)
    groups = spark.createDataFrame(list(GROUPS.items()), "feature string, group string")
    b = aggregate.coef_box(coefs, groups)
    return b.select("group", "feature", *[r6(c, c) for c in ["q1", "median", "q3", "mean"]], "n_outliers")


@query("linear_predictor", V.with_views(
    "SELECT event_id, round(value * 0.01 + k * -0.005 + is_click * 0.2 + hour * 0.003, 6) AS lp, "
    "round(exp(value * 0.01 + k * -0.005 + is_click * 0.2 + hour * 0.003), 6) AS hazard_ratio FROM surv_events",
    "surv_events"))
def linear_predictor(spark, sf):
    lp = aggregate.linear_predictor({"value": 0.01, "k": -0.005, "is_click": 0.2, "hour": 0.003})
    return V.surv_events(spark, sf).select("event_id", r6(lp, "lp"), r6(F.exp(lp), "hazard_ratio"))


ROC_SQL = """
WITH s AS (SELECT value * 0.01 + k * -0.005 + is_click * 0.2 + hour * 0.003 AS sc, event FROM surv_events),
per AS (SELECT sc AS threshold, CAST(sum(event) AS DOUBLE) AS p, CAST(sum(1 - event) AS DOUBLE) AS q FROM s GROUP BY sc),
c AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM per
      WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(p) AS P, sum(q) AS N FROM per)
SELECT round(threshold, 6) AS threshold, tp, fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr,
       round((tp + N - fp) / (P + N), 6) AS accuracy FROM c, t
"""


@query("roc_table", V.with_views(ROC_SQL, "surv_events"))
def roc_table(spark, sf):
    lp = aggregate.linear_predictor({"value": 0.01, "k": -0.005, "is_click": 0.2, "hour": 0.003})
    r = aggregate.roc_table(V.surv_events(spark, sf).select(lp.alias("sc"), "event"), "sc", "event")
    return r.select(r6("threshold", "threshold"), "tp", "fp", r6("tpr", "tpr"), r6("fpr", "fpr"),
                    r6("accuracy", "accuracy"))


ROC_AUC_SQL = """
WITH per AS (SELECT value * 0.01 + k * -0.005 + is_click * 0.2 + hour * 0.003 AS sc, CAST(sum(event) AS DOUBLE) AS p,
                    CAST(sum(1 - event) AS DOUBLE) AS q FROM surv_events GROUP BY ALL),
c AS (SELECT p, q, sum(p) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) - p / 2 AS won FROM per)
SELECT sum(p) AS positives, sum(q) AS negatives, round(sum(q * won) / (sum(p) * sum(q)), 6) AS auc FROM c
"""


@query("roc_auc", V.with_views(ROC_AUC_SQL, "surv_events"))
def roc_auc(spark, sf):
    lp = aggregate.linear_predictor({"value": 0.01, "k": -0.005, "is_click": 0.2, "hour": 0.003})
    got = aggregate.roc_auc(V.surv_events(spark, sf).select(lp.alias("sc"), "event"), "sc", "event")
    return got.select("positives", "negatives", r6("auc", "auc"))


STRIP_SQL = """
SELECT row_number() OVER (ORDER BY time, event, event_id) - 1 AS position, event_id, round(time, 6) AS time, event,
       round(value * 0.01 + k * -0.005 + is_click * 0.2 + hour * 0.003, 6) AS risk_score FROM surv_events
"""


@query("risk_strip", V.with_views(STRIP_SQL, "surv_events"))
def risk_strip(spark, sf):
    lp = aggregate.linear_predictor({"value": 0.01, "k": -0.005, "is_click": 0.2, "hour": 0.003})
    scores = V.surv_events(spark, sf).select("event_id", "time", "event", lp.alias("risk_score"))
    strip = aggregate.risk_strip(scores, "event_id")
    return strip.select("position", "event_id", r6("time", "time"), "event", r6("risk_score", "risk_score"))


AUC_CURVE_SQL = FOLD_CORE + """
, det AS (SELECT a.test_fold AS fold, a.event, a.time,
                 a.value * w.b_value + a.k * w.b_k + a.hour * w.b_hour AS risk
          FROM a JOIN (SELECT fold, max(CASE WHEN feature = 'value' THEN coef END) AS b_value,
                              max(CASE WHEN feature = 'k' THEN coef END) AS b_k,
                              max(CASE WHEN feature = 'hour' THEN coef END) AS b_hour FROM co GROUP BY fold) w
          ON a.test_fold = w.fold),
grid AS (SELECT * FROM (VALUES (12.0), (24.0), (48.0)) g(gt)),
x AS (SELECT d.fold, g.gt, d.risk,
             CASE WHEN d.event = 1 AND d.time <= g.gt THEN 1.0 ELSE 0.0 END AS W,
             CASE WHEN d.time > g.gt THEN 1.0 ELSE 0.0 END AS C FROM det d, grid g),
red AS (SELECT fold, gt, risk, sum(W) AS W, sum(C) AS C FROM x GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(C) OVER (PARTITION BY fold, gt ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS Cl FROM red),
auc AS (SELECT fold, gt AS time, sum(W * (Cl + 0.5 * C)) / (sum(W) * sum(C)) AS auc FROM cum GROUP BY ALL)
SELECT time, count(*) AS n, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.5), 6) AS median,
       round(stddev_samp(auc), 6) AS sd, round(1.96 * stddev_samp(auc) / sqrt(count(*)), 6) AS ci95
FROM auc GROUP BY time
"""


@query("auc_curve", V.with_views(AUC_CURVE_SQL, "surv_events"))
def auc_curve(spark, sf):
    """Rows 96-97: per-fold AUC(t) (unweighted cases, i.e. G = 1) of the
    fold models on their test rows at t = 12, 24, 48 h, then mean / median /
    sd / 1.96 sem over folds."""
    coefs, ev, asg = fold_coefficients(spark, sf)
    det = fold_risk_detail(coefs, ev, asg)
    grid = F.array(*[F.lit(g) for g in (12.0, 24.0, 48.0)])
    x = det.select("fold", "risk_score", "time", "event", F.explode(grid).alias("gt"))
    W = F.when((F.col("event") == 1) & (F.col("time") <= F.col("gt")), 1.0).otherwise(0.0)
    C = F.when(F.col("time") > F.col("gt"), 1.0).otherwise(0.0)
    red = x.groupBy("fold", "gt", "risk_score").agg(F.sum(W).alias("W"), F.sum(C).alias("C"))
    from ..operators.kernels import cumulative
    cum = cumulative(red, ["risk_score"], {"Cl": "C"}, segment=["fold", "gt"], exclusive=True)
    auc = cum.groupBy("fold", F.col("gt").alias("time")).agg(
        (F.sum(F.col("W") * (F.col("Cl") + 0.5 * F.col("C"))) / (F.sum("W") * F.sum("C"))).alias("auc"))
    s = aggregate.auc_curve_summary(auc)
    return s.select("time", "n", *[r6(c, c) for c in ["mean", "median", "sd", "ci95"]])
