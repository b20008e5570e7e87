"""The queries of this subpackage, each over its whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join, quality, secret_scan, token_count, token_records, toxicity, vocab


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: str = "doc_id"):
    return (F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and the text they decode to, as digests; a null text counts as empty, one row for each row."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and confirmed secrets of every text, one row for each row; a null text counts as empty and has no spans."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every text, one row for each row, learnt from labels of rows that aren't held out; null and empty texts have severity 0."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(), "severity", "p_toxic", "grade", "toxic")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row with the largest doc_id of its equal texts; a null text equals an empty one."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every text, empty and null ones too, one row for each row, learnt from labels of rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    found = quality.rank(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, `und` without a letter, one row for each row, learnt from lang of rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", _held_out(), "lang_pred", "score", "bits_per_byte")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and its end id, written as framed records in the order of doc_id and read back, one row for each row."""
    found = token_records.write_records(_table(spark, sf_dir, "documents"), vocab.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of bytes and tokens of every text, one row for each row; a null text counts as empty."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items of whose five-word shingles they contain 0.8 or more; an item of fewer words is one shingle."""
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.85 or more of four-word shingles, one row for each row; texts without words stand alone."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_secret_scan": op2_secret_scan,
        "op3_toxicity": op3_toxicity,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_quality": op5_quality,
        "op6_language_id": op6_language_id,
        "op7_token_records": op7_token_records,
        "op8_token_counts": op8_token_counts,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_join": op10_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op9_decontamination": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
                 b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
                 bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
                 ks AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
                 dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
                 n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
            SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
            FROM dg JOIN bs USING (s) JOIN n USING (item_id)
            GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    }
