"""Threshold-scaled document sketches: every shingle hash below a fixed fraction is kept.

Built-in functions only.  A sketch is the sorted array of the different
hashes of a text's five-word shingles that lie in the lowest ``FRACTION`` of
the 64-bit range, or the least hash where none does.  Its size follows the
text, so containment between a short and a very long text can be estimated,
and the union of two sketches is the sketch of the shingles of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen, shuffle_partitions

SHINGLE_WORDS = 5
FRACTION = 0.25
#: Stands for a null doc_id inside joins: the least long.
NO_ID = -(1 << 63)


def _limit(fraction: float) -> int:
    """Hashes under this signed number are the given share of all."""
    return min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1)


def sketch(text: Column, width: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """Sorted array of kept hashes; a null text, or one without words, has none.

    Words are lower-cased runs without ASCII white space; a text of fewer
    than ``width`` words is one shingle.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashed), lambda h: _kept(h, width, fraction))[0]


def _kept(h: Column, width: int, fraction: float) -> Column:
    """The kept hashes of the shingles of the word hashes ``h``."""
    rows = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                       lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    shingles = (F.when(F.size(h) >= width, rows)
                .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    below = _limit(fraction)
    kept = F.transform(F.array(shingles), lambda s: F.when(
        F.exists(s, lambda x: x < below), F.filter(s, lambda x: x < below)).otherwise(
        F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(s)))[0]
    return F.sort_array(F.array_distinct(kept))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of both texts."""
    below = _limit(fraction)
    both = F.array_union(a, b)
    return F.sort_array(F.when(F.exists(both, lambda x: x < below), F.filter(both, lambda x: x < below)).when(
        F.size(both) > 0, F.array(F.array_min(both))).otherwise(both))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one has; 1 for two empty ones, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))).cast("double")


def as_string(kept: Column) -> Column:
    """The hashes as 16 lower-case hex digits each."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_smaller(ids: DataFrame) -> DataFrame:
    """(key, next_key): the next key in descending order; after the least comes the greatest.

    The distinct keys are range-partitioned, each range looks at its own rows,
    and only the first row of a range takes the greatest key of the range
    before it, from a table of one row a range.
    """
    spark = ids.sparkSession
    dealt = frozen(ids.select("key").distinct().repartitionByRange(
        shuffle_partitions(spark), "key").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("key")
    rows = dealt.select("key", "part", F.lag("key").over(inside).alias("before"))
    ends = dealt.groupBy("part").agg(F.max("key").alias("greatest"))
    over = Window.orderBy("part")  # one row a range
    first = ends.select("part", F.coalesce(F.lag("greatest").over(over), F.max("greatest").over(
        Window.partitionBy())).alias("carry"))
    return rows.join(first, "part").select("key", F.coalesce("before", "carry").alias("next_key"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The last floor(n/3) code points are replaced by the first as many (or
    all) of the next document in descending doc_id.  Returns doc_id, n_chars,
    edited (text), kept, edited_kept (sketches), near_edited, near_next.

    Null texts are empty; a null doc_id comes after all others.  Repeated
    rows stay, with equal results; where a doc_id has several texts, the least
    of them is what the document before it sees.  An empty table gives an
    empty result; a single document is its own next.
    """
    # a key that is never null keeps one partitioning through the grouping and both joins
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
                        F.coalesce("text", F.lit("")).alias("text"))
    takes = frozen(texts.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).alias("take")))
    gives = next_smaller(takes).join(takes, "key").select(F.col("key").alias("giver_of"), "next_key", "take")
    heads = texts.join(gives, texts["key"] == gives["next_key"]).select(
        F.col("giver_of").alias("key"), F.substring("text", F.lit(1), F.col("take").cast("int")).alias("head"),
        sketch(F.col("text")).alias("next_kept"))
    donors = heads.groupBy("key").agg(F.min(F.struct("head", "next_kept")).alias("gift"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = texts.join(donors, "key").select(
        F.nullif(F.col("key"), F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("gift.head", F.lit(1), third)).alias("edited"),
        sketch(F.col("text")).alias("kept"), F.col("gift.next_kept").alias("next_kept"))
    made = rows.withColumn("edited_kept", sketch(F.col("edited")))
    return made.select("doc_id", "n_chars", "edited", "kept", "edited_kept",
                       containment(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
                       containment(F.col("kept"), F.col("next_kept")).alias("near_next"))
