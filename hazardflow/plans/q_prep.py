"""Registered queries: missing values, imputation, scaling, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe, prep
from ..sources import views as V
from .registry import query, r6

NUM = ["value", "k", "hour"]
MODE_COLS = ["value", "k", "hour", "is_click"]


def _unpivot_sql(src: str, cols: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)


MISSING_SQL = f"""
WITH u AS ({_unpivot_sql('surv_events_n', NUM)})
SELECT feature, count(*) AS n, count(x) AS non_missing,
       round(1.0 - count(x) / count(*), 6) AS missing_share
FROM u GROUP BY feature
"""


@query("missing_profile", V.with_views(MISSING_SQL, "surv_events_n"))
def missing_profile(spark, sf):
    p = prep.missing_profile(V.surv_events(spark, sf, with_nulls=True), NUM)
    return p.select("feature", "n", "non_missing", r6("missing_share", "missing_share"))


MODE_SQL = f"""
WITH u AS ({_unpivot_sql('surv_events', MODE_COLS)}),
c AS (SELECT feature, x, count(*) AS cnt FROM u WHERE x IS NOT NULL GROUP BY feature, x),
b AS (SELECT feature, cnt, x, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, x ASC) AS rn FROM c)
SELECT feature, cnt AS mode_count, x AS mode_value,
       round(cnt / (SELECT count(*) FROM surv_events), 6) AS mode_share
FROM b WHERE rn = 1
"""


@query("mode_share", V.with_views(MODE_SQL, "surv_events"))
def mode_share(spark, sf):
    m = prep.mode_share(V.surv_events(spark, sf), MODE_COLS)
    return m.select("feature", "mode_count", "mode_value", r6("mode_share", "mode_share"))


def _impute_sql(stat: str) -> str:
    if stat == "mean":
        fit = ", ".join(f"avg({c}) AS f_{c}" for c in NUM)
    elif stat == "median":
        fit = ", ".join(f"quantile_cont({c}, 0.5) AS f_{c}" for c in NUM)
    elif stat == "constant":
        fit = ", ".join(f"max(0.0) AS f_{c}" for c in NUM)
    else:
        raise ValueError(stat)
    # row filter (row 9): >= round(3 * 0.8) = 2 non-missing values among NUM
    nn = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in NUM)
    return f"""
WITH fit AS (SELECT {fit} FROM surv_events_n WHERE {nn} >= 2)
SELECT event_id, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), f_{c}), 6) AS {c}" for c in NUM)}
FROM surv_events_n, fit
"""


MODE_IMPUTE_SQL = f"""
WITH u AS ({_unpivot_sql('surv_events_n', NUM)}),
c AS (SELECT feature, x, count(*) AS cnt FROM u WHERE x IS NOT NULL GROUP BY feature, x),
b AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, x ASC) AS rn FROM c),
fit AS (SELECT {", ".join(f"max(CASE WHEN feature = '{c}' THEN x END) AS f_{c}" for c in NUM)} FROM b WHERE rn = 1)
SELECT event_id, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), f_{c}), 6) AS {c}" for c in NUM)}
FROM surv_events_n, fit
"""


def _impute(spark, sf, strategy):
    df = V.surv_events(spark, sf, with_nulls=True)
    fit_rows = df.filter(prep.row_filter(NUM, 0.8))
    imp = prep.Imputer(strategy).fit(fit_rows, NUM)
    out = imp.transform(df)
    return out.select("event_id", *[r6(c, c) for c in NUM])


@query("impute_mean", V.with_views(_impute_sql("mean"), "surv_events_n"))
def impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


@query("impute_median", V.with_views(_impute_sql("median"), "surv_events_n"))
def impute_median(spark, sf):
    return _impute(spark, sf, "median")


@query("impute_mode", V.with_views(MODE_IMPUTE_SQL, "surv_events_n"))
def impute_mode(spark, sf):
    return _impute(spark, sf, "most_frequent")


@query("impute_constant", V.with_views(_impute_sql("constant"), "surv_events_n"))
def impute_constant(spark, sf):
    return _impute(spark, sf, "constant")


def _scaled(spark, sf, scaler):
    df = V.surv_events(spark, sf)
    s = scaler.fit(df, NUM)
    exprs = s.columns({c: prep.clean(c) for c in NUM})
    return df.select("event_id", *[r6(e, c) for c, e in exprs.items()])


def _scale_sql(fit: str, expr: str) -> str:
    return f"""
WITH fit AS (SELECT {fit} FROM surv_events)
SELECT event_id, {", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in NUM)}
FROM surv_events, fit
"""


STD_SQL = _scale_sql(", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in NUM),
                     "({c} - m_{c}) / s_{c}")
ROBUST_SQL = _scale_sql(", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, "
    f"coalesce(nullif(quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1), 0), 1) AS s_{c}" for c in NUM),
    "({c} - m_{c}) / s_{c}")
MINMAX_SQL = _scale_sql(", ".join(f"min({c}) AS m_{c}, coalesce(nullif(max({c}) - min({c}), 0), 1) AS s_{c}"
                                  for c in NUM), "({c} - m_{c}) / s_{c}")
MAXABS_SQL = _scale_sql(", ".join(f"coalesce(nullif(max(abs({c})), 0), 1) AS s_{c}" for c in NUM),
                        "{c} / s_{c}")
NORM = "sqrt(" + " + ".join(f"{c} * {c}" for c in NUM) + ")"
ROWNORM_SQL = f"""
SELECT event_id, {", ".join(f"round(CASE WHEN {NORM} > 0 THEN {c} / {NORM} ELSE {c} END, 6) AS {c}" for c in NUM)}
FROM surv_events
"""


@query("scale_standard", V.with_views(STD_SQL, "surv_events"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, prep.Standard())


@query("scale_robust", V.with_views(ROBUST_SQL, "surv_events"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, prep.Robust(10, 90))


@query("scale_minmax", V.with_views(MINMAX_SQL, "surv_events"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, prep.MinMax())


@query("scale_maxabs", V.with_views(MAXABS_SQL, "surv_events"))
def scale_maxabs(spark, sf):
    return _scaled(spark, sf, prep.MaxAbs())


@query("scale_rownorm", V.with_views(ROWNORM_SQL, "surv_events"))
def scale_rownorm(spark, sf):
    return _scaled(spark, sf, prep.RowNormalizer())


@query("scale_chain", V.with_views(f"""
WITH m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in NUM)}
           FROM surv_events),
z AS (SELECT event_id, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NUM)} FROM surv_events, m),
fit AS (SELECT {", ".join(f"min({c}) AS m_{c}, coalesce(nullif(max({c}) - min({c}), 0), 1) AS s_{c}" for c in NUM)} FROM z)
SELECT event_id, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUM)} FROM z, fit
""", "surv_events"))
def scale_chain(spark, sf):
    df = V.surv_events(spark, sf)
    ch = prep.ScalerChain(["S", "M"]).fit(df, NUM)
    out = ch.transform(df.select("event_id", *NUM))
    return out.select("event_id", *[r6(c, c) for c in NUM])


ORD_SQL = """
WITH lv AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS idx
            FROM (SELECT DISTINCT event_type FROM surv_events))
SELECT s.event_id, lv.idx AS event_type FROM surv_events s JOIN lv USING (event_type)
"""


@query("ordinal", V.with_views(ORD_SQL, "surv_events"))
def ordinal(spark, sf):
    df = V.surv_events(spark, sf)
    o = prep.Ordinal().fit(df, ["event_type"])
    return df.select("event_id", o.columns({"event_type": F.col("event_type")})["event_type"].alias("event_type"))


LEVELS = ["click", "error", "purchase", "signup", "view"]
ONEHOT_SQL = f"""
SELECT event_id, {", ".join(f"CAST(event_type = '{v}' AS DOUBLE) AS event_type_{v}" for v in LEVELS)}
FROM surv_events
"""


@query("onehot", V.with_views(ONEHOT_SQL, "surv_events"))
def onehot(spark, sf):
    df = V.surv_events(spark, sf)
    o = prep.OneHot().fit(df, ["event_type"])
    ex = o.columns({"event_type": F.col("event_type")})
    return df.select("event_id", *[e.alias(c) for c, e in ex.items()])


def _quantile_sql(c: str) -> str:
    """Knots at i / (m - 1) of the sorted values, and the interval of each
    value; a value on repeated knots takes the middle of their references."""
    return f"""
s_{c} AS (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS p, count(*) OVER () AS n
          FROM surv_events WHERE {c} IS NOT NULL),
r_{c} AS (SELECT CASE WHEN i = m - 1 THEN CAST(1 AS DOUBLE) ELSE i * (CAST(1 AS DOUBLE) / (m - 1)) END AS r,
                 (SELECT max(n) FROM s_{c}) AS n FROM m, range(1000) t(i) WHERE i < m),
k_{c} AS (SELECT r, a.v + (b.v - a.v) * (r * (r_{c}.n - 1) - floor(r * (r_{c}.n - 1))) AS q
          FROM r_{c} JOIN s_{c} a ON a.p = CAST(floor(r * (r_{c}.n - 1)) AS BIGINT)
                     JOIN s_{c} b ON b.p = CAST(ceil(r * (r_{c}.n - 1)) AS BIGINT)),
e_{c} AS (SELECT q, min(r) AS r0, max(r) AS r1, lead(q) OVER (ORDER BY q) AS q2, lead(min(r)) OVER (ORDER BY q) AS r2
          FROM k_{c} GROUP BY q),
t_{c} AS (SELECT event_id, CASE WHEN CAST({c} AS DOUBLE) = q OR q2 IS NULL THEN (r0 + r1) / 2
                                ELSE r1 + ({c} - q) * (r2 - r1) / (q2 - q) END AS x
          FROM surv_events ASOF JOIN e_{c} ON CAST(surv_events.{c} AS DOUBLE) >= e_{c}.q)"""


QUANTILE_SQL = ("WITH m AS (SELECT least(1000, count(*)) AS m FROM surv_events),"
                + ",".join(_quantile_sql(c) for c in NUM)
                + "\nSELECT event_id, " + ", ".join(f"round(t_{c}.x, 6) AS {c}" for c in NUM)
                + f"\nFROM t_{NUM[0]} " + " ".join(f"JOIN t_{c} USING (event_id)" for c in NUM[1:]))


@query("quantile_transform", V.with_views(QUANTILE_SQL, "surv_events"))
def quantile_transform(spark, sf):
    return _scaled(spark, sf, prep.Quantile(1000))


@query("power_transform")
def power_transform(spark, sf):
    return _scaled(spark, sf, prep.Power())


# -- descriptive -------------------------------------------------------------------
PEARSON_COLS = ["value", "k", "hour", "is_click"]
PEARSON_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM surv_events"
    for a in PEARSON_COLS for b in PEARSON_COLS)


@query("pearson_matrix", V.with_views(PEARSON_SQL, "surv_events"))
def pearson_matrix(spark, sf):
    return describe.pearson_long(V.surv_events(spark, sf), PEARSON_COLS).select(
        "feature_a", "feature_b", r6("r", "r"))


VIF_COLS = ["value", "k", "hour"]


def _vif_sql():
    a, b, c = VIF_COLS
    r = {("a", "b"): f"corr({a}, {b})", ("a", "c"): f"corr({a}, {c})", ("b", "c"): f"corr({b}, {c})"}
    base = f"SELECT {r[('a','b')]} AS rab, {r[('a','c')]} AS rac, {r[('b','c')]} AS rbc FROM surv_events"

    def one(name, x, y, z):
        # R^2 of `name` on the other two = (x^2 + y^2 - 2 x y z) / (1 - z^2)
        r2 = f"(({x})*({x}) + ({y})*({y}) - 2*({x})*({y})*({z})) / (1 - ({z})*({z}))"
        vif = f"1.0 / (1.0 - {r2})"
        return (f"SELECT '{name}' AS feature, round({vif}, 6) AS vif, "
                f"CASE WHEN {vif} <= 5 THEN 'low' WHEN {vif} < 10 THEN 'moderate' ELSE 'high' END AS band FROM r")
    return (f"WITH r AS ({base})\n" + "\nUNION ALL\n".join([
        one(a, "rab", "rac", "rbc"), one(b, "rab", "rbc", "rac"), one(c, "rac", "rbc", "rab")]))


@query("vif", V.with_views(_vif_sql(), "surv_events"))
def vif(spark, sf):
    return describe.vif(V.surv_events(spark, sf), VIF_COLS).select("feature", r6("vif", "vif"), "band")


HIST_SQL = f"""
WITH u AS ({_unpivot_sql('surv_events', NUM)}),
r AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM u GROUP BY feature)
SELECT feature, CAST(least(floor((x - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n
FROM u JOIN r USING (feature) WHERE x IS NOT NULL GROUP BY ALL
"""


@query("histogram", V.with_views(HIST_SQL, "surv_events"))
def histogram(spark, sf):
    return describe.histogram(V.surv_events(spark, sf), NUM, bins=100)


DESCRIBE_SQL = f"""
WITH u AS ({_unpivot_sql('surv_events', NUM)})
SELECT feature, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max
FROM u GROUP BY feature
"""


@query("describe", V.with_views(DESCRIBE_SQL, "surv_events"))
def describe_q(spark, sf):
    d = describe.describe(V.surv_events(spark, sf), NUM)
    return d.select("feature", "count", *[r6(c, c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


STATUS_SQL = "SELECT event, count(*) AS n FROM surv_lines GROUP BY event"


@query("status_counts", V.with_views(STATUS_SQL, "surv_lines"))
def status_counts(spark, sf):
    return describe.status_counts(V.surv_lines(spark, sf), "event")
