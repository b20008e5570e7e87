"""Connected components by alternating large-star and small-star steps, each a join and a map-side combined minimum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.runtime import discard, lean, staged

#: Edges that a task takes into one forest.
FOREST = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition's edges as stars around the smallest member, which drops edges that close a cycle there."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        ends = [(x, root(x)) for x in up]
        ends = [(x, y) for x, y in ends if x != y]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], schema.field(i).type) for i in (0, 1)], ["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > FOREST:
            yield stars(schema)
            up.clear()
    if up:
        yield stars(schema)


def _star(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step on pairs (u, v) with u > v; rows never exceed twice the input's."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge, staged; component is the smallest node reachable.

    Null ends and self-loops are ignored; no edges give no rows. Each round is written to the shared folder, which then
    lets go of the one before; rounds go on until nothing moves, which takes the logarithm of the longest path or so.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    pairs = pairs.where("ok and u <> v").select("u", "v").distinct()
    pairs = staged(pairs.mapInArrow(lean(_forest), pairs.schema), "star")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was, now = None, print_of(pairs)
    while now[0] and now != was:
        before, pairs = pairs, staged(_star(pairs), "star")
        discard(before)
        was, now = now, print_of(pairs)
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
    out.staged_at = pairs.staged_at
    return out
