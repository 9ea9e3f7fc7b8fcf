"""The corpus pipeline: stages over ``documents``, each one of the operators of ``hazardflow.llm``.

toxicity        drops the documents that the toxicity score rejects
near duplicates keeps the document of least doc_id of each SimHash component
suffix dedup    takes repeated 100-byte strings out of the texts; n_chars follows
packing         packs the token ids of what is left into sequences

Each stage gets the rows that its predecessor kept, written as Parquet and
read again, with every column of ``documents`` and any further ones.  Rows of
equal doc_id and text are equal for every stage; the near-duplicate stage
keeps one of them.  A null text is empty, a null doc_id a document of its own.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.llm import packing, simhash, suffix_dedup, toxicity
from hazardflow.llm.common import shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under the threshold; the model learns from ``labels`` as the operator's query does."""
    model = toxicity.train_split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of SimHash links: that of the component's least doc_id."""
    return simhash.keep_first(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that earlier documents, or earlier places, have too."""
    return suffix_dedup.clean_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the documents left."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates),
          ("suffix_dedup", drop_repeated_strings), ("best_fit_packing", pack_sequences)]
#: Learned scores, SimHash and byte-level matches can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
