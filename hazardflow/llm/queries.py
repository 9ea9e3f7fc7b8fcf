"""Registered queries of the document operators: thin digests over each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@register("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.fingerprints import as_string, edited_pairs

    made = edited_pairs(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       as_string(F.col("kept")).alias("fingerprint"),
                       as_string(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next")


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_NEAREST_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.x, r.x) AS score
  FROM v q JOIN v r ON len(q.x) = len(r.x) AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM n WHERE k <= 20
"""


@register("op7_nearest_neighbours", _NEAREST_SQL)
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.toxicity import THRESHOLD, held_out, score, train_split

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train_split(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.url_filter import Rule, judge

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    return judge(table(spark, sf_dir, "pages"), rules)


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _word_tokenizer(), end_id=1)


@register("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), _word_tokenizer())
    return packed.withColumn("length", F.col("length").cast("long"))


@register("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hazardflow.llm.piece_tokens import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _kept_digest(data: bytes, runs: list[tuple[int, int]]) -> tuple:
    import hashlib

    from hazardflow.llm.suffix_dedup import without

    return len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest()


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), [F.col("doc_id")], _kept_digest,
                           "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.sharding import shard

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("link"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))


#: Terms are cut by a pattern; only A-Z is lower-cased.
_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS kinds, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
w AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(w.total, 0) + 5 * v.kinds) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (v.lang_total + 5 * v.kinds) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN w USING (lang, source)),
o AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(o.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM s WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM parts)
SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank FROM n WHERE part = 'pair' OR k <= 50
"""


@register("op12_source_divergence", _DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.divergence import Audit

    audit = Audit(table(spark, sf_dir, "documents"))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(audit.pair_parts(), "pair").unionByName(named(audit.term_parts(), "term"))


def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Six rounds of assignment and floored means, one set of tables a round."""
    steps = [f"""
z AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid,
         list_transform(embedding, lambda x: CAST(floor({4096} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS MATERIALIZED (
  SELECT rid, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS x
  FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS i FROM z)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM c WHERE rid <= {entries})"""]

    def nearest(k):
        return f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, entry, d FROM (
    SELECT rid, part, entry, d, row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) AS k FROM (
      SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
      FROM c JOIN b{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY c.rid, c.part, b.entry)) WHERE k = 1)"""

    for k in range(rounds):
        steps += [nearest(k), f"""
m{k} AS MATERIALIZED (
  SELECT a.part, a.entry, c.pos, sum(c.x) AS s, count(*) AS n
  FROM a{k} a JOIN c ON c.rid = a.rid AND c.part = a.part GROUP BY a.part, a.entry, c.pos),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, CAST(CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS x
  FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""]
    steps += [nearest(rounds), f"""
e AS (
  SELECT z.vec_id, z.label, string_agg(printf('%02x', CAST(a.entry AS INTEGER)), '' ORDER BY a.part) AS code, sum(a.d) AS error
  FROM z JOIN a{rounds} a ON a.rid = z.rid GROUP BY z.rid, z.vec_id, z.label),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256 FROM e, h"""]
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]


@register("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.vector_codes import compress, digest

    encoded, book = compress(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return encoded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


#: All pairs that share a shingle, each different set once; the closure over links of different sets.
_NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END)) AS x FROM d),
k AS MATERIALIZED (SELECT row_number() OVER () AS node, x, len(x) AS n FROM (SELECT DISTINCT x FROM s WHERE len(x) > 0)),
m AS MATERIALIZED (SELECT s.doc_id, k.node, k.n FROM s JOIN k ON s.x = k.x),
u AS MATERIALIZED (SELECT node, n, unnest(x) AS g FROM k),
e AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.g = b.g AND a.node <> b.node
    AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 80),
c(node, peer) AS (SELECT node, node FROM k UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.peer),
l AS (SELECT c.node, min(m.doc_id) AS component_id FROM c JOIN m ON m.node = c.peer GROUP BY c.node),
o AS (
  SELECT m.doc_id, m.n AS n_shingles, l.component_id FROM m JOIN l ON l.node = m.node
  UNION ALL SELECT doc_id, 0, doc_id FROM s WHERE len(x) = 0)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""


@register("op11_minhash_near_dedup", _NEAR_SQL)
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazardflow.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))
