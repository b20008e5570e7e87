"""Exact duplicates by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.runtime import staged

SALTS = 16


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays.
    A null doc_id stays only if no equal text has one; a repeated (doc_id, text) row has the same values each time.
    Other columns are ignored, and an empty table gives no rows.

    Each task first merges its own equal texts; a salt taken from the task spreads what is left of a hot text over
    `salts` reducers, whose winners are merged again. Digest and full text are the grouping key of both stages, so equal
    digests never stand for equal texts. Members then look their digest up in a table of one narrow row for each text
    (the join is one that adaptive execution can split); only texts whose digest is shared by different texts, if there
    are any, are looked up by digest and text.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    local = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = staged(winners.select("digest", "keep_id", "group_size").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")), "winners")
    found = keyed.select("doc_id", "digest").join(by_digest.where("texts = 1").drop("texts"), "digest")
    clashes = by_digest.where("texts > 1").select("digest")
    if clashes.first() is not None:
        some = winners.join(clashes, "digest", "left_semi")
        found = found.unionByName(keyed.join(some, ["digest", "text"]).drop("text"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of docs for each distinct text, with all its columns: the one with the largest doc_id (null is the smallest).

    The same two stages as in exact_duplicates, with the whole row carried along, so no join follows. Of rows that
    repeat both doc_id and text any one stays. A null text equals an empty one.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    # the document's own columns stand in a struct of their own, so that no name can clash
    kept = F.struct(F.struct(*[docs[c] for c in docs.columns if c != "text"], F.lit(0).alias("text")).alias("own"), docs["text"].isNull().alias("none"))
    keyed = docs.select(kept.alias("row"), order.alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("t", 256))).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = keyed.groupBy("digest", "t", "salt").agg(F.max_by("row", "o").alias("row"), F.max("o").alias("o"))
    winners = salted.groupBy("digest", "t").agg(F.max_by("row", "o").alias("row"))
    return winners.select(*[F.when(~F.col("row")["none"], F.col("t")).alias(c) if c == "text" else F.col("row")["own"][c].alias(c) for c in docs.columns])
