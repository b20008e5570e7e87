"""Conditions over a snapshot of the graph, for a set of anchors at once.

Three ways of narrowing a relation's events stay apart: `around` (symmetric window; the type isn't looked at if it is
empty or the anchor's own), `behind` (strict type, window backwards from the anchor) and `filtered` (as behind, without
a count; an empty type lets all pass).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from causeway.operators import relations
from causeway.plans.dsl import Condition, Term


def known(pairs: DataFrame, anchors: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs with the anchor's and the event's columns."""
    own = anchors.select("anchor_id", F.col("event_type").alias("a_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("a_at"))
    return pairs.join(own, "anchor_id").join(events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "event_id")


def _equal(df: DataFrame, name: str, value):
    """Whether a property equals a wanted value: numbers equal numbers, texts texts, truth values truth values; anything else differs."""
    if name not in df.columns:
        return F.lit(value is None)
    if value is None:
        return F.col(name).isNull()
    held = df.schema[name].dataType
    fits = isinstance(held, BooleanType) if isinstance(value, bool) else isinstance(held, NumericType) if isinstance(value, (int, float)) else isinstance(held, StringType) if isinstance(value, str) else True
    return F.col(name).eqNullSafe(F.lit(value)) if fits else F.lit(False)


def _props(pairs: DataFrame, props) -> DataFrame:
    """Every wanted value equal; a wanted None also matches a property that isn't there."""
    for name, value in props.items():
        pairs = pairs.where(_equal(pairs, name, value))
    return pairs


def around(pairs: DataFrame, event_type: str, window: int | None, props) -> DataFrame:
    if event_type:
        pairs = pairs.where((F.col("a_type") == event_type) | (F.col("event_type") == event_type))
    if window is not None:
        pairs = pairs.where(F.col("at").between(F.col("a_at") - window, F.col("a_at") + window))
    return _props(pairs, props)


def behind(pairs: DataFrame, event_type: str, window: int | None, props) -> DataFrame:
    pairs = pairs.where(F.col("event_type") == event_type)
    if window is not None:
        pairs = pairs.where(F.col("at").between(F.col("a_at") - window, F.col("a_at")))
    return _props(pairs, props)


def filtered(pairs: DataFrame, event_type: str, window: int | None, props) -> DataFrame:
    return behind(pairs, event_type, window, props) if event_type else behind(pairs.withColumn("event_type", F.lit("")), "", window, props)


def peer_pairs(anchors: DataFrame, events: DataFrame, edges: DataFrame, event_type: str, window: int | None) -> DataFrame:
    """Parentless events that HasPeers looks at: the anchor's type and domain if event_type is the anchor's, else that type in any domain.

    With a window both sides are cut into buckets of its width and only neighbouring buckets are joined.
    """
    free = relations.parentless(events, edges).where(F.col("event_type") == event_type).select("event_id", F.col("domain").alias("e_domain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("e_at"))
    own = anchors.select("anchor_id", "event_type", "domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("o_at"))
    rest = (F.col("event_type") != event_type) | (F.col("domain") == F.col("e_domain"))
    if window:
        bucket = lambda c: F.floor(F.col(c) / window)
        own = own.withColumn("bucket", F.explode(F.array(*[bucket("o_at") + i for i in (-1, 0, 1)])))
        joined = own.join(free.withColumn("bucket", bucket("e_at")), "bucket")
    else:
        # same-type anchors meet their own domain only, by an equal join; others meet the whole pool of that type
        same = own.where(F.col("event_type") == event_type).withColumnRenamed("domain", "e_domain").join(free, "e_domain").withColumn("domain", F.col("e_domain"))
        other = own.where(F.col("event_type") != event_type).withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one").drop("one")
        joined = same.select("anchor_id", "event_type", "domain", "event_id", "e_domain").unionByName(other.select("anchor_id", "event_type", "domain", "event_id", "e_domain"))
    return joined.where(rest & (F.col("event_id") != F.col("anchor_id"))).select("anchor_id", "event_id")


def peer_counts(term: Term, anchors: DataFrame, events: DataFrame, edges: DataFrame, count: str) -> DataFrame:
    """(anchor_id, count): how many events a HasPeers term finds, without forming pairs; other ids than those of anchors come too.

    Without a window, pools are counted by domain. With one, time is cut into buckets of the window's full width, so it
    reaches over two at most, and what lies in it is told by running counts at its two ends.
    """
    t, window = term.value, term.options.window
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    free = _props(relations.parentless(events, edges).where(F.col("event_type") == t), term.options.props).select("event_id", "domain", at.alias("at"))
    own = anchors.select("anchor_id", "domain", F.coalesce(F.col("event_type") == t, F.lit(False)).alias("same"), at.alias("at")).where("not same or domain is not null")
    itself = free.where("domain is not null").select(F.col("event_id").alias("anchor_id"), F.lit(-1).cast("long").alias("c"))
    if window is None:
        by_domain = free.groupBy("domain").agg(F.count("*").alias("c"))
        at_home = own.where("same").join(by_domain, "domain").select("anchor_id", "c")
        abroad = own.where("not same").select("anchor_id", F.lit(free.count()).alias("c"))
        return at_home.unionByName(abroad).unionByName(itself).groupBy("anchor_id").agg(F.sum("c").alias(count))
    width = 2 * window + 1
    bucket = lambda c: F.floor(c / F.lit(width))
    # what an anchor of the type itself looks at is its own domain; others look at all, which is the null domain
    where = F.when(F.col("same"), F.col("domain"))
    low, high = F.col("at") - window, F.col("at") + window
    edge = lambda x, step, over: F.struct(bucket(x).alias("bucket"), x.alias("x"), F.lit(step).alias("step"), over.alias("across"))
    across = bucket(low) != bucket(high)
    ends = own.select("anchor_id", where.alias("pool"), F.explode(F.array(edge(low, 0, across), edge(high, 2, across))).alias("e")).select("anchor_id", "pool", "e.*")
    seen = [free.select(F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"), p.alias("pool"), bucket(F.col("at")).alias("bucket"), F.col("at").alias("x"), F.lit(1).alias("step"), F.lit(False).alias("across")) for p in (F.col("domain"), F.lit(None).cast("string"))]
    rows = ends.unionByName(seen[0].where("pool is not null")).unionByName(seen[1])
    whole = Window.partitionBy("pool", "bucket")
    running = whole.orderBy("x", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.when(F.col("step") == 1, 1).otherwise(0)
    told = rows.withColumn("upto", F.sum(one).over(running)).withColumn("all", F.sum(one).over(whole)).where("step <> 1")
    c = F.when(F.col("step") == 2, F.col("upto")).when(F.col("across"), F.col("all") - F.col("upto")).otherwise(-F.col("upto"))
    return told.select("anchor_id", c.cast("long").alias("c")).unionByName(itself).groupBy("anchor_id").agg(F.sum("c").alias(count))


def truth(condition: Condition):
    """A condition of types and domains only, as one expression over an event's columns; ValueError if it has another term."""

    def value(term: Term):
        if term.kind not in ("type", "domain", "any_type"):
            raise ValueError(f"{term.kind} needs the graph")
        column = F.col("domain" if term.kind == "domain" else "event_type")
        return F.coalesce(column.isin(*term.value) if term.kind == "any_type" else column == term.value, F.lit(False))

    return condition.decide(value, lambda a, b: a & b, lambda a, b: a | b)


def matched(term: Term, anchors: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """(anchor_id, event_id) rows of a relational term."""
    ids, o, t = anchors.select("anchor_id"), term.options, term.value
    if term.kind == "child":
        pairs = relations.children(ids, edges).distinct()
        found = around(known(pairs, anchors, events).where(F.col("event_type") == t), t, o.window, o.props)
    elif term.kind == "descendants":
        found = around(known(relations.ancestors(ids, edges, max(o.depth, 1)).drop("depth"), anchors, events), t, o.window, o.props)
    elif term.kind == "siblings":
        found = behind(known(relations.siblings(ids, edges), anchors, events), t, o.window, o.props)
    elif term.kind == "cousin":
        found = around(known(relations.cousins(ids, edges, o.depth or 1), anchors, events), t, o.window, o.props)
    elif term.kind == "peers":
        found = around(known(peer_pairs(anchors, events, edges, t, o.window), anchors, events), t, o.window, o.props)
    else:
        raise ValueError(f"{term.kind} relates to no events")
    return found.select("anchor_id", "event_id")


def evaluate(condition: Condition, anchors: DataFrame, events: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchor_id, ok, n_matched) for every anchor, and (anchor_id, term, event_id) of all terms, false ones included.

    anchors: events under the name anchor_id. Every term counts, whatever the others say.
    """
    condition.postfix()
    out, rows, names = anchors, [], {}
    for i, term in enumerate(condition.terms()):
        if term.kind in ("type", "domain", "any_type"):
            column = F.col("domain" if term.kind == "domain" else "event_type")
            ok = column.isin(*term.value) if term.kind == "any_type" else column == term.value
        else:
            found = matched(term, anchors, events, edges)
            rows.append(found.withColumn("term", F.lit(i)))
            counts = peer_counts(term, anchors, events, edges, f"n{i}") if term.kind == "peers" else found.groupBy("anchor_id").agg(F.count("*").alias(f"n{i}"))
            out = out.join(counts, "anchor_id", "left").withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(0)))
            n, o = F.col(f"n{i}"), term.options
            ok = n > 0 if o.how_many is None else n >= o.how_many if o.or_more else n == o.how_many
        names[id(term)] = i
        out = out.withColumn(f"t{i}", F.coalesce(ok, F.lit(False)))
    true = condition.decide(lambda t: F.col(f"t{names[id(t)]}"), lambda a, b: a & b, lambda a, b: a | b)
    counts = [F.col(c) for c in out.columns if c[0] == "n" and c[1:].isdigit()]
    total = reduce(lambda a, b: a + b, counts, F.lit(0)).cast("long")
    all_rows = reduce(DataFrame.unionByName, rows) if rows else anchors.select("anchor_id", F.lit(0).alias("term"), F.col("anchor_id").alias("event_id")).limit(0)
    return out.select("anchor_id", true.alias("ok"), total.alias("n_matched")), all_rows
