"""Survival views derived from the driver's parquet tables.

The driver tables carry no survival data, so two views are derived:

``surv_events``
    One row per event: hours until the same user's next ``error`` event,
    censored at 72 h and at the end of the observation window.  The Spark
    version computes "next error" per (user, hour bucket) plus a per-user
    suffix minimum over bucket summaries, so a user holding a third of all
    rows is spread over many tasks instead of one window partition.
``surv_lines``
    One row per line item: time = quantity (50 distinct values, heavy
    ties), event = returned, numeric features from the joined dimensions.

Each view also has a DuckDB SQL text (``*_SQL``) used by the oracles; it is
the plain single-window formulation of the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the view definitions (shared by Spark and the SQL oracle).
HORIZON_HOURS = 72.0
WINDOW_END_US = 1706659200000000  # 2024-01-31 00:00:00 UTC in microseconds
MIN_TIME = 1e-6
US_PER_HOUR = 3600000000.0
EVENT_FEATURES = ["value", "k", "hour", "is_click", "is_view", "is_signup", "is_purchase"]
LINE_FEATURES = ["l_discount", "l_tax", "o_totalprice", "p_size", "c_acctbal"]


def surv_events(spark: SparkSession, sf_dir: str, with_nulls: bool = False,
                bucket_hours: int = 1) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = ev.withColumn("_us", us).withColumn(
        "_bucket", F.floor(F.col("_us") / F.lit(US_PER_HOUR * bucket_hours)))
    err_us = F.when(F.col("event_type") == "error", F.col("_us"))
    w_in = (Window.partitionBy("user_id", "_bucket").orderBy("_us", "event_id")
            .rowsBetween(1, Window.unboundedFollowing))
    ev = ev.withColumn("_nx_in", F.min(err_us).over(w_in))
    # Bucket summaries: at most one row per (user, hour with events).
    summ = ev.groupBy("user_id", "_bucket").agg(F.min(err_us).alias("_first_err"))
    w_after = (Window.partitionBy("user_id").orderBy("_bucket")
               .rowsBetween(1, Window.unboundedFollowing))
    summ = summ.withColumn("_nx_later", F.min("_first_err").over(w_after)).drop("_first_err")
    ev = ev.join(summ, ["user_id", "_bucket"], "left")
    nx = F.least(F.col("_nx_in"), F.col("_nx_later"))
    h_next = (nx - F.col("_us")).cast("double") / F.lit(US_PER_HOUR)
    h_end = (F.lit(WINDOW_END_US) - F.col("_us")).cast("double") / F.lit(US_PER_HOUR)
    is_event = nx.isNotNull() & (h_next <= HORIZON_HOURS) & (h_next <= h_end)
    time = F.greatest(
        F.when(is_event, h_next).otherwise(F.least(F.lit(HORIZON_HOURS), h_end)),
        F.lit(MIN_TIME))
    value = F.col("value")
    if with_nulls:
        value = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise(value)
    et = F.col("event_type")
    return ev.select(
        "event_id", "user_id", "event_type",
        time.alias("time"),
        is_event.cast("int").alias("event"),
        value.alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"),
        (et == "click").cast("int").alias("is_click"),
        (et == "view").cast("int").alias("is_view"),
        (et == "signup").cast("int").alias("is_signup"),
        (et == "purchase").cast("int").alias("is_purchase"),
    )


def surv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_returnflag", "l_discount", "l_tax")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(c, F.col("o_custkey") == c.c_custkey))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("double").alias("time"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        "l_discount", "l_tax", "o_totalprice",
        F.col("p_size").cast("double").alias("p_size"), "c_acctbal")


# ---------------------------------------------------------------------------
# DuckDB formulations (oracle side).  Each is a CTE body.
SURV_EVENTS_SQL = f"""
SELECT event_id, user_id, event_type,
       greatest(CASE WHEN ev THEN h_next ELSE least({HORIZON_HOURS}, h_end) END, {MIN_TIME}) AS time,
       CAST(ev AS INTEGER) AS event,
       value, k, hour, is_click, is_view, is_signup, is_purchase
FROM (
  SELECT *, (nx IS NOT NULL AND h_next <= {HORIZON_HOURS} AND h_next <= h_end) AS ev
  FROM (
    SELECT event_id, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
           CAST(hour(ts) AS DOUBLE) AS hour,
           CAST(event_type = 'click' AS INTEGER) AS is_click,
           CAST(event_type = 'view' AS INTEGER) AS is_view,
           CAST(event_type = 'signup' AS INTEGER) AS is_signup,
           CAST(event_type = 'purchase' AS INTEGER) AS is_purchase,
           CAST(nx - epoch_us(ts) AS DOUBLE) / {US_PER_HOUR} AS h_next,
           CAST({WINDOW_END_US} - epoch_us(ts) AS DOUBLE) / {US_PER_HOUR} AS h_end,
           nx
    FROM (
      SELECT *, min(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (
               PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx
      FROM events) a) b) c
"""

SURV_EVENTS_N_SQL = f"""
SELECT event_id, user_id, event_type, time, event,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
       k, hour, is_click, is_view, is_signup, is_purchase
FROM ({SURV_EVENTS_SQL}) s
"""

SURV_LINES_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
       CAST(l.l_quantity AS DOUBLE) AS time,
       CAST(l.l_returnflag = 'R' AS INTEGER) AS event,
       l.l_discount, l.l_tax, o.o_totalprice, CAST(p.p_size AS DOUBLE) AS p_size, c.c_acctbal
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (``surv_events``, ``surv_events_n``, ``surv_lines``)."""
    bodies = {"surv_events": SURV_EVENTS_SQL, "surv_events_n": SURV_EVENTS_N_SQL,
              "surv_lines": SURV_LINES_SQL}
    ctes = ",\n".join(f"{n} AS ({bodies[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
