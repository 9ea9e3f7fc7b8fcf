"""SimHash near-duplicate detection by deletion-variant signatures.

A fingerprint has one bit per position of the shingle hashes: 1 if set in
over half of them.  Two fingerprints link at ``MAX_BITS`` = 2 or fewer
differing bits.  Cut into two segments of 32 bits, two such fingerprints have
a segment that differs by at most one bit, so they share one of the 64
variants "this segment with this bit blanked".  Variants are joined by
equality and the pairs verified on all 64 bits.

A variant shared by more than ``HOT`` fingerprints is not expanded into pairs.
Its members go through the neighbour expansion: a fingerprint and its 64
one-bit neighbours; all members of one such value are within two bits of each
other, so linking each of them to the least one loses no link.  Both ways are
linear in the number of different fingerprints.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen, shuffle_partitions, texts_of
from hazardflow.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Most members of a variant whose pairs are listed; larger ones take the neighbour expansion.
HOT = 64
#: Most variant keys (two longs a row) that are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Shingle hashes counted at once, which bounds memory on very long texts.
BLOCK = 1 << 16


def _fingerprint(data: bytes | None, width: int) -> int:
    import numpy as np
    import xxhash

    words = (data or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        width = len(words)
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    spans = list(zip(starts[:n].tolist(), ends[width - 1:].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([h64(joined[s:e], 42) for s, e in spans[k:k + BLOCK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text; a null text is empty.

    Texts without words have fingerprint zero; texts of fewer words than
    ``width`` are one shingle.  Other columns of ``docs`` are not looked at.
    """
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [_fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return texts_of(docs, as_binary=True).mapInArrow(
        run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key): the segment (bit 37), the blanked bit (32-36) and the segment's other bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    rows = fps.select("fp", low.alias("low"), high.alias("high"),
                      F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    return rows.select("fp", F.expr(
        "(IF(v < 32, low, high) & ~shiftleft(1L, v % 32)) | shiftleft(CAST(v AS BIGINT), 32)").alias("key"))


def _neighbours(fps: DataFrame) -> DataFrame:
    """(fp, key): the fingerprint and each of its 64 one-bit neighbours."""
    flips = F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v")
    return fps.select("fp", flips).select(
        "fp", F.expr("IF(v = 64, fp, fp ^ shiftleft(1L, v))").alias("key"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a < b) whose components are those of all pairs at ``MAX_BITS`` or fewer bits."""
    variants = _variants(fps)
    shared = frozen(variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    twos = shared.where("n = 2").where(close).select("a", "b")
    more = shared.where("n > 2").select("key", "n")
    if more.count() <= BROADCAST_KEYS:
        more = F.broadcast(more)
    members = frozen(variants.join(more, "key").select("key", "n", "fp"))
    cold = members.where(F.col("n") <= hot).select("key", "fp")
    pairs = (cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key")
             .where("a < b").where(close).select("a", "b"))
    near = _neighbours(members.where(F.col("n") > hot).select("fp").distinct())
    least = near.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(least, "key").where("a < fp").select("a", F.col("fp").alias("b"))
    return twos.unionByName(pairs).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links, itself included.

    A null doc_id keeps its row and takes no part in the minimum; a component
    of null ids alone has a null id.  An empty table gives an empty result.
    """
    prints = frozen(fingerprints(docs, width))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # dealt anew after the counting: 64 variants a fingerprint are made next
    dealt = fps.select("fp").repartition(shuffle_partitions(docs.sparkSession), "fp")
    roots = components(links(dealt))
    classes = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(classes.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def _hashed_prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, fp): the fingerprint of every text beside the text's SHA-256."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            hashes = pa.array([hashlib.sha256(t or b"").hexdigest() for t in texts])
            fps = pa.array([_fingerprint(t, width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), hashes, fps], names=["doc_id", "hash", "fp"])

    return texts_of(docs.select("doc_id", "text"), as_binary=True).mapInArrow(run, "doc_id long, hash string, fp long")


def _private(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it differ from every column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_first(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that of its least doc_id.

    Of several texts of that id in the component the one of least hash stays,
    of rows equal in id and text one.  An id that holds the least place in
    several components keeps a row in each.  Rows without a doc_id all stay.
    Columns may have any names and types.
    """
    mark, doc, first = (_private(docs, n) for n in ("mark", "mark_doc", "mark_first"))
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    named = docs.where("doc_id IS NOT NULL")
    # rows without an id are no copies of others here, but they link what lies between
    of_text = frozen(_hashed_prints(docs, width))
    fps = of_text.select("fp").distinct()
    roots = components(links(fps.repartition(shuffle_partitions(docs.sparkSession), "fp")))
    placed = of_text.where("doc_id IS NOT NULL").join(roots, F.col("fp") == F.col("node"), "left").select(
        F.coalesce("root", "fp").alias("root"), F.struct("doc_id", "hash").alias("row"))
    least = placed.groupBy("root").agg(F.min("row").alias("row")).select(
        F.col("row.doc_id").alias(doc), F.col("row.hash").alias(first))
    marked = named.withColumn(mark, text)
    kept = marked.join(least, (marked["doc_id"] == least[doc]) & (marked[mark] == least[first]), "left_semi")
    kept = kept.dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.union(docs.where("doc_id IS NULL"))
