"""From raw documents to token ids: five operators in a row, each stage written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. doc_id names a document; where it is missing or
repeated, doc_id and text together do, and an exact copy's largest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join, vocab
from causeway.runtime import staged

#: Ids up to which a list of documents to drop is broadcast (40 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs that are not among dropped(text_sha256), or dropped(text_sha256, doc_id), where a null doc_id equals another."""
    dropped = staged(dropped.distinct(), "dropped")
    if dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        dropped = dropped.hint("broadcast")
    same = ngram_join.text_digest("text") == dropped["text_sha256"]
    if "doc_id" in dropped.columns:
        same &= docs["doc_id"].eqNullSafe(dropped["doc_id"])
    return docs.join(dropped, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that no learned language codes in under 8 bits a byte."""
    return language_id.in_a_language(docs, language_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest doc_id stays.

    A document without a doc_id stays only if its component has none; of equal or missing ids the smallest text digest stays.
    """
    return _without(docs, ngram_join.near_copies(docs, k=5, percent=80))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain 0.8 or more of a benchmark item's five-word shingles, each text for itself, whatever its doc_id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(ngram_join.text_digest("text").alias("doc_id"), "text")
    return _without(docs, decontaminate.contained_items(texts, items, k=5, percent=80).select(F.col("doc_id").alias("text_sha256")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document that is left."""
    return bpe.encode_decode(docs, vocab.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", token_ids),
]

#: The language model's arithmetic has no SQL form, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return staged(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
