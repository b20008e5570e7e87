"""Short test items inside long documents: size-partitioned bottom-m MinHash containment search, in DataFrame operations only.

The items are partitioned by size (powers of two of distinct shingles). An item's sketch is its m smallest shingle
hashes, m set by the upper size bound of its partition so that a document with the wanted containment can't miss all of
them: it lacks at most `miss` shingles, and m > miss. The sketches are matched with the shingle hashes of all documents,
and a document that has at least m - miss sketch values of an item is a candidate. Documents are not sketched: the
minimum hashes of a long document say next to nothing about 40 words inside it. Candidates are then read again and
verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.runtime import staged

#: Rows up to which a side is broadcast (16 to 40 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Items up to which their shingle texts are broadcast.
BROADCAST_ITEMS = 20_000


def words(text: str) -> Column:
    """Runs of letters and digits, in lower case; null has none."""
    return F.expr(rf"filter(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')")


def _hashes(k: int) -> Column:
    return F.expr(f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({k}, {', '.join(f'w[i + {j}]' for j in range(k))})) ELSE CAST(array() AS array<bigint>) END")


def _shingles(k: int) -> Column:
    return F.expr(f"CASE WHEN size(w) >= {k} THEN array_distinct(transform(sequence(0, size(w) - {k}), i -> concat_ws(' ', slice(w, i + 1, {k})))) ELSE CAST(array() AS array<string>) END")


def _sized(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, otherwise as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared) with 100 * n_shared >= percent * n_item.

    docs has doc_id and text, items item_id and text; other columns are ignored. Words are runs of letters and digits in
    lower case; n_item counts an item's distinct k-word shingles, n_shared those that the document has too. An item of
    fewer words is one shingle of them all; one without words is found nowhere, as is any item in a document with fewer
    words than a shingle. A null text has no words; null ids are matched like any other. Repeated rows give one pair
    (the largest n_shared); an empty table gives no pairs.
    """
    lines = items.select("item_id", words("text").alias("w")).where("size(w) > 0").withColumn("k", F.least(F.lit(k), F.size("w")))
    sizes = sorted(r[0] for r in lines.select("k").distinct().collect())
    per_k = lambda f, d: F.coalesce(*[F.when(F.col("k") == x, f(x)) for x in sizes]) if sizes else d
    none = F.array().cast("array<bigint>")
    sketched = lines.select("item_id", F.array_sort(F.array_distinct(per_k(_hashes, none))).alias("h"))
    n = F.size("h")
    miss = F.floor(n * (100 - percent) / 100)
    upper = F.expr("CAST(shiftleft(1, CAST(floor(log2(size(h))) AS int) + 1) - 1 AS int)")
    m = F.least(n, F.floor(upper * F.lit(100 - percent) / 100) + 1).cast("int")
    sketches = staged(sketched.select("item_id", (m - miss).alias("least_hits"), F.explode_outer(F.slice("h", F.lit(1), m)).alias("h")), "sketches")

    tokens = docs.select("doc_id", words("text").alias("w"))
    lists = [_hashes(x) for x in sizes] or [none]
    # explode_outer, since explode would have the optimiser filter by the array's size first and compute it twice, word by word
    hashed = tokens.select("doc_id", F.explode_outer(F.concat(*lists) if len(lists) > 1 else lists[0]).alias("h"))
    hits = hashed.join(_sized(sketches, BROADCAST_ROWS), "h").groupBy("doc_id", "item_id", "least_hits", "h").count()
    candidates = hits.groupBy("doc_id", "item_id", "least_hits").agg(F.count("*").alias("hits")).where("hits >= least_hits").select("doc_id", "item_id")
    candidates = staged(candidates, "candidates")

    exact = lines.select(F.col("item_id").alias("item"), F.col("k").alias("k"), per_k(_shingles, F.array().cast("array<string>")).alias("wanted"))
    pairs = _sized(candidates.withColumnRenamed("doc_id", "doc"), BROADCAST_ROWS)
    read = docs.select("doc_id", "text").join(pairs, F.col("doc_id").eqNullSafe(F.col("doc"))).drop("doc")
    found = read.join(_sized(exact, BROADCAST_ITEMS), F.col("item_id").eqNullSafe(F.col("item"))).withColumn("w", words("text"))
    shared = found.select("doc_id", "item_id", F.size("wanted").alias("n_item"), F.size(F.array_intersect("wanted", per_k(_shingles, F.array().cast("array<string>")))).alias("n_shared"))
    # filtered after the aggregate: a filter below it would be pushed under the projection of the words and split them for each shingle
    best = shared.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.where(100 * F.col("n_shared") >= percent * F.col("n_item"))
