"""Graph relations for a whole set of anchors at once, as joins on edges. Results are (anchor_id, event_id) and what is named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from causeway.runtime import discard, shared_folder, staged


def _up(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("from_id").alias("event_id"), F.col("to_id").alias("next"))
    return frontier.join(e, "event_id").select("anchor_id", F.col("next").alias("event_id"))


def _down(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("to_id").alias("event_id"), F.col("from_id").alias("next"))
    return frontier.join(e, "event_id").select("anchor_id", F.col("next").alias("event_id"))


def _start(anchors: DataFrame) -> DataFrame:
    return anchors.select("anchor_id", F.col("anchor_id").alias("event_id"))


def children(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Contributors, one row for each inbound edge."""
    return _down(_start(anchors), edges)


def parents(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived events, one row for each outbound edge."""
    return _up(_start(anchors), edges)


def levels_up(anchors: DataFrame, edges: DataFrame, depth: int) -> list[DataFrame]:
    """Events first reached after 1, 2, ... depth outbound edges. A level that another one follows is written, so a plan holds one level."""
    frontier, out = _start(anchors), []
    for i in range(depth):
        frontier = _new(_up(frontier, edges), out)
        if i + 1 < depth:
            frontier = staged(frontier, "frontier")
        out.append(frontier)
    return out


def _new(reached: DataFrame, before: list[DataFrame]) -> DataFrame:
    """Distinct pairs but for the anchor itself and those of earlier levels."""
    new = reached.where("event_id <> anchor_id").distinct()
    return new.join(reduce(DataFrame.union, before), ["anchor_id", "event_id"], "left_anti") if before else new


def _by_levels(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    levels = [f.withColumn("depth", F.lit(i + 1)) for i, f in enumerate(levels_up(anchors, edges, depth))]
    return reduce(DataFrame.union, levels)


def _spread(anchors: DataFrame, edges: DataFrame, inner: bool = True) -> DataFrame:
    """Distinct edges, written once, with what is asked of their contributors: is this its only edge (`single`), is it an anchor, and if wanted, is it itself derived (`inner`)."""
    e = edges.select("from_id", "to_id").where("from_id is not null and to_id is not null")
    own = Window.partitionBy("from_id")
    known = e.withColumn("before", F.lag("to_id").over(own.orderBy("to_id"))).withColumn("single", F.min("to_id").over(own) == F.max("to_id").over(own)).where("before is null or before <> to_id")
    asked = anchors.select(F.col("anchor_id").alias("from_id")).distinct().withColumn("anchor", F.lit(True))
    out = known.join(asked, "from_id", "left").select("from_id", "to_id", "single", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    if inner:
        derived = e.select(F.col("to_id").alias("from_id")).distinct().withColumn("inner", F.lit(True))
        out = out.join(derived, "from_id", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return staged(out, "spread")


def _chains(spread: DataFrame, depth: int) -> DataFrame:
    """(p, chain, plain) of derived events with outbound edges: the one event above each, the one above that, and so on, up to depth.

    Where an event has several above it or comes back to an earlier one, it isn't plain, nor is what lies below it.
    """
    inner = spread.where("inner")
    one = inner.where("single").select(F.col("from_id").alias("p"), F.col("to_id").alias("next"))
    none = F.array().cast(f"array<{spread.schema['to_id'].dataType.simpleString()}>")
    fork = inner.where("not single").select(F.col("from_id").alias("p")).distinct().select("p", none.alias("chain"), F.lit(False).alias("plain"))
    chains = fork.limit(0)
    for _ in range(depth):
        above = chains.select(F.col("p").alias("next"), F.col("chain").alias("rest"), F.col("plain").alias("rest_plain"))
        longer = one.join(above, "next", "left").select("p", F.concat(F.array("next"), F.coalesce("rest", none)).alias("chain"), F.coalesce("rest_plain", F.lit(True)).alias("plain"))
        fresh = (F.size(F.array_distinct("chain")) == F.size("chain")) & ~F.array_contains("chain", F.col("p"))
        chains = staged(longer.select("p", "chain", (F.col("plain") & fresh).alias("plain")).unionByName(fork), "chains")
    return chains


def _paths(spread: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Anchors above which there is one event at each distance at most, with these events as (anchor_id, p, chain), p the first of them; and other anchors, None if there are none."""
    hop = spread.where("anchor and single").select(F.col("from_id").alias("anchor_id"), F.col("to_id").alias("p"), "inner")
    all_of = lambda h: h.join(chains, "p", "left").select("anchor_id", "p", F.concat(F.array("p"), F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType))).alias("chain"), F.coalesce("plain", F.lit(True)).alias("plain"))
    plain = F.col("plain") & ~F.array_contains("chain", F.col("anchor_id"))
    # only what is derived itself can lie above itself
    doubtful = hop if chains.where("not plain").first() is not None else hop.where("inner")
    rest = spread.where("anchor and not single").select(F.col("from_id").alias("anchor_id")).distinct().unionByName(all_of(doubtful).where(~plain).select("anchor_id"))
    rest = staged(rest, "rest")
    return all_of(hop).where(plain).select("anchor_id", "p", "chain"), None if rest.first() is None else rest


def _climb(anchors: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Derived events up to depth edges away as (anchor_id, event_id, depth): of anchors with one at each distance, and of others."""
    spread = _spread(anchors, edges)
    paths, rest = _paths(spread, _chains(spread, depth - 1))
    plain = paths.select("anchor_id", F.posexplode("chain").alias("at", "event_id")).select("anchor_id", "event_id", (F.col("at") + 1).alias("depth"))
    return plain, None if rest is None else _by_levels(rest, edges, depth)


def ancestors(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Derived events up to depth edges away with their distance; depth 0 or less gives none."""
    if depth < 1:
        return _start(anchors).limit(0).withColumn("depth", F.lit(0))
    plain, others = _climb(anchors, edges, depth)
    return plain if others is None else plain.unionByName(others)


def ancestor_levels(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(anchor_id, depth, n, top): how many ancestors there are at each distance, and the greatest id; only anchors with several are grouped."""
    count = lambda rows: rows.groupBy("anchor_id", "depth").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    if depth < 1:
        return count(ancestors(anchors, edges, depth))
    plain, others = _climb(anchors, edges, depth)
    one = plain.select("anchor_id", "depth", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("top"))
    return one if others is None else one.unionByName(count(others))


def closure_by_depth(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """contributors_closure() with the number of edges from the anchor to the row's end as `depth`."""
    frontier, before, out = _start(anchors), [], []
    for i in range(max(depth, 0)):
        reached = _down(frontier, edges)
        if i + 1 < depth:
            reached = staged(reached, "reached")
        out.append(reached.withColumn("depth", F.lit(i + 1)))
        frontier = _new(reached, before)
        before.append(reached)
    return reduce(DataFrame.union, out) if out else frontier.limit(0).withColumn("depth", F.lit(0))


def contributors_closure(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """One row for each inbound edge of each distinct event within depth - 1 edges below the anchor."""
    return closure_by_depth(anchors, edges, depth).drop("depth")


def siblings(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct other contributors of any parent. Only an anchor with several parents can meet one twice, so only its pairs are made distinct."""
    spread = _spread(anchors, edges, inner=False)
    below = spread.select("to_id", F.col("from_id").alias("event_id"))
    met = lambda which: spread.where(f"anchor and {which}").select("to_id", F.col("from_id").alias("anchor_id")).join(below, "to_id").where("event_id <> anchor_id").select("anchor_id", "event_id")
    if spread.where("anchor and not single").first() is None:
        return met("single")
    return met("single").unionByName(met("not single").distinct())


def cousins(anchors: DataFrame, edges: DataFrame, depth: int, exclude_siblings: bool = False) -> DataFrame:
    """Distinct events as many edges below an ancestor as it is above the anchor; siblings are those of one edge."""
    found = []
    for i, level in enumerate(levels_up(anchors, edges, max(depth, 0))):
        for _ in range(i + 1):
            level = _down(level, edges).distinct()
        found.append(level)
    if not found:
        return _start(anchors).limit(0)
    out = reduce(DataFrame.union, found).where("event_id <> anchor_id")
    out = out.distinct() if len(found) > 1 else out
    return out.join(siblings(anchors, edges), ["anchor_id", "event_id"], "left_anti") if exclude_siblings else out


def cousin_counts(anchors: DataFrame, edges: DataFrame, depth: int, exclude_siblings: bool = False) -> DataFrame:
    """(anchor_id, n): how many cousins() finds, where it finds any.

    Where one event at most lies above the anchor at each distance, all that it finds at a smaller distance it finds at
    the greatest one too. So n is the number of events that reach the topmost event in as many steps, less the anchor
    (or less the siblings and the anchor), and no pairs are formed. They are formed for other anchors only.
    """
    if depth < 1:
        return anchors.select("anchor_id", F.lit(0).cast("long").alias("n")).limit(0)
    spread = _spread(anchors, edges)
    below = staged(spread.groupBy(F.col("to_id").alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("single").cast("long")).alias("own")), "below")
    up = spread.where("inner").select(F.col("from_id").alias("z"), F.col("to_id").alias("next"))
    forked = spread.where("not single").select("from_id", F.col("to_id").alias("p"))
    forks = forked.first() is not None
    # p reaches z in i - 1 steps; `own` events have p alone above them, so they reach z in i
    walks, reached = below.select("p", F.col("p").alias("z"), "own"), [below.select(F.lit(1).alias("i"), F.col("p").alias("z"), "n")]
    for i in range(2, depth + 1):
        walks = staged(walks.join(up, "z").groupBy("p", F.col("next").alias("z")).agg(F.max("own").alias("own")), "walks")
        found = walks.select("z", "own")
        if forks:
            found = found.unionByName(forked.join(walks, "p").select("from_id", "z").distinct().select("z", F.lit(1).cast("long").alias("own")))
        reached.append(found.groupBy("z").agg(F.sum("own").alias("n")).select(F.lit(i).alias("i"), "z", "n"))
    chains = _chains(spread, depth - 1)
    paths, rest = _paths(spread, chains)
    whole = below.select("p", F.col("n").alias("near")).join(chains.where("plain"), "p", "left")
    tops = whole.select("p", "near", (F.coalesce(F.size("chain"), F.lit(0)) + 1).alias("i"), F.coalesce(F.element_at("chain", -1), "p").alias("z"))
    totals = tops.join(reduce(DataFrame.union, reached), ["i", "z"]).select("p", (F.col("n") - (F.col("near") if exclude_siblings else 1)).alias("n"))
    out = paths.select("anchor_id", "p").join(totals.where("n > 0"), "p").select("anchor_id", "n")
    return out if rest is None else out.unionByName(cousins(rest, edges, depth, exclude_siblings).groupBy("anchor_id").agg(F.count("*").alias("n")))


def parentless(events: DataFrame, edges: DataFrame) -> DataFrame:
    return events.join(edges.select(F.col("from_id").alias("event_id")), "event_id", "left_anti")


def peers(anchors: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """Parentless other events of an anchor's type and domain, for a chosen set of anchors."""
    own = anchors.join(events, anchors["anchor_id"] == events["event_id"]).select("anchor_id", "event_type", "domain")
    free = parentless(events, edges).select("event_id", "event_type", "domain")
    return own.join(free, ["event_type", "domain"]).where("event_id <> anchor_id").select("anchor_id", "event_id")


def peer_counts(events: DataFrame, edges: DataFrame) -> DataFrame:
    """How many peers every event has, without forming the pairs: a count by type and domain, less itself if it is free."""
    free = parentless(events, edges).select("event_id", F.lit(1).alias("free"))
    pools = parentless(events, edges).groupBy("event_type", "domain").agg(F.count("*").alias("pool"))
    known = events.select("event_id", "event_type", "domain").join(free, "event_id", "left").join(pools, ["event_type", "domain"], "left")
    return known.select("event_id", (F.coalesce("pool", F.lit(0)) - F.coalesce("free", F.lit(0))).cast("long").alias("n_peers"))


def derivation_levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """0 for an event without contributors, else one more than its highest contributor's level; ValueError if there is a cycle.

    What is at level k or above are the events with a contributor at level k - 1 or above, so each round looks only at
    what the last one left. A round that leaves all of it would never end: there is a cycle.
    """
    nodes = ids.select("event_id").distinct()
    derived = edges.select(F.col("to_id").alias("event_id")).distinct().withColumn("inner", F.lit(True))
    out = edges.select(F.col("from_id").alias("event_id"), F.col("to_id").alias("next"))
    # of events that nothing contributes to, what they contribute to is all that is needed
    rows = nodes.join(derived, "event_id", "left").join(out, "event_id", "left").where("inner or next is not null")
    up = staged(rows.select(F.when(F.col("inner"), F.col("event_id")).alias("event_id"), "next"), "up")
    left, path = up.select("event_id").where("event_id is not null").distinct(), shared_folder(ids.sparkSession, "levels")
    k, least = 0, None
    while least != 0:
        k += 1
        (up.select(F.col("next").alias("event_id")).distinct().join(left, "event_id", "left_semi")).write.parquet(f"{path}/level={k}")
        left = ids.sparkSession.read.schema(left.schema).parquet(f"{path}/level={k}")
        n = left.count()
        if n and n == least:
            raise ValueError("the graph has a cycle")
        least, before = n, up
        up = staged(up.where("next is not null").join(left, "event_id", "left_semi"), "up")
        discard(before)
    discard(up)
    reached = ids.sparkSession.read.schema(StructType([*left.schema.fields, StructField("level", IntegerType())])).parquet(path)
    top = reached.groupBy("event_id").agg(F.max("level").alias("level"))
    return nodes.join(top, "event_id", "left").select("event_id", F.coalesce("level", F.lit(0)).alias("level"))


def windowed_peer_counts(events: DataFrame, before: int, after: int) -> DataFrame:
    """Other events of the same type and domain within [ts - before, ts + after] (micros, inclusive), by a range frame."""
    at = Window.partitionBy("event_type", "domain").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-before, after)
    return events.select("event_id", (F.count("*").over(at) - 1).alias("n_matched"))
