"""Helpers shared by the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, read through Spark (any store it reaches)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Narrow rows (a few numbers each) that are worth a task of their own.
ROWS_A_TASK = 1 << 16


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, in as many partitions as they are worth.

    A table of links shrinks from round to round while the session's shuffle
    partitions are set for the texts; without this each of its exchanges
    writes a file for every one of them, mostly empty.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1_000


def texts_of(docs: DataFrame, as_binary: bool = False) -> DataFrame:
    """(doc_id long, text) for Python tasks, in small batches.

    Whole texts are long: Spark's usual 10,000 rows a batch take more of an
    executor's memory than they are worth, so the session's number is lowered
    if it is higher.
    """
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    text = F.col("text").cast("binary") if as_binary else F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points that split ``column`` evenly.

    Only the cut points reach the driver.  Nulls count as smallest; an empty
    table has no cut points.
    """
    if parts < 2:
        return []
    got = df.select(F.col(column).cast("double").alias("k")).approxQuantile(
        "k", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in got})


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], salts: int = 64,
           name: str = "rank") -> DataFrame:
    """Gapless numbers from 0 within ``group``, without a task per group.

    Rows of a group are dealt over ``salts`` hash buckets of ``order``; a
    bucket numbers its own rows and starts after the buckets before it.  The
    bucket sizes are a table of at most groups x salts rows.  ``order`` must
    tell the rows of a group apart for the numbers to be repeatable.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)))
    sizes = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    a, b = numbered.alias("a"), starts.alias("b")
    same = F.col("a._salt") == F.col("b._salt")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns],
                                  (F.col("a._row") + F.col("b._start")).cast("long").alias(name))
