"""Events and edges as DataFrames, and the graphs that the test tables give.

events: event_id, event_type, domain, ts, seq (total order of ingest), and properties as columns.
edges: from_id (contributor), to_id (derived), relation; several edges between two events are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with one domain for each user; property k stays a number."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.concat(F.lit("user_"), "user_id").alias("domain"), "ts", F.col("event_id").alias("seq"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items contribute to orders, orders to customers, customers to nations, nations to regions."""
    li = table(spark, sf_dir, "lineitem").select(line_id().alias("from_id"), F.concat(F.lit("o:"), "l_orderkey").alias("to_id"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("from_id"), F.concat(F.lit("c:"), "o_custkey").alias("to_id"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("from_id"), F.concat(F.lit("n:"), "c_nationkey").alias("to_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("from_id"), F.concat(F.lit("r:"), "n_regionkey").alias("to_id"))
    return li.union(o).union(c).union(n).withColumn("relation", F.lit("trigger"))


def trade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id of every line item, order, customer, nation and region."""
    out = table(spark, sf_dir, "lineitem").select(line_id().alias("event_id"))
    for prefix, name, key in (("o:", "orders", "o_orderkey"), ("c:", "customer", "c_custkey"), ("n:", "nation", "n_nationkey"), ("r:", "region", "r_regionkey")):
        out = out.union(table(spark, sf_dir, name).select(F.concat(F.lit(prefix), key)))
    return out


def line_id():
    """Order key and line number repeat; with part, supplier and ship date they name a line."""
    return F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")))


def add_event(events: DataFrame, new: DataFrame) -> DataFrame:
    return events.unionByName(new, allowMissingColumns=True)


def dangling_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with an end that no event has; they must not be added."""
    ids = events.select("event_id")
    at = lambda c: edges.join(ids, edges[c] == ids["event_id"], "left_anti")
    return at("from_id").unionByName(at("to_id")).distinct()


def add_edges(edges: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """edges and new ones; raises ValueError if an end of a new one is missing."""
    if dangling_edges(new, events).first() is not None:
        raise ValueError("from/to event not found")
    return edges.unionByName(new, allowMissingColumns=True)


def require(wanted: DataFrame, events: DataFrame, column: str = "event_id") -> None:
    """Raises ValueError if an id of wanted's column is no event's; for anchors that must be known."""
    ids = events.select(F.col("event_id").alias("known"))
    lost = wanted.join(ids, wanted[column].eqNullSafe(ids["known"]), "left_anti").select(column).first()
    if lost is not None:
        raise ValueError(f"event not found: {lost[0]}")


def by_id(events: DataFrame, event_id, strict: bool = False) -> DataFrame:
    """The event of an id; an unknown one gives no row, or with `strict` ValueError."""
    found = events.where(F.col("event_id") == event_id)
    if strict and found.first() is None:
        raise ValueError(f"event not found: {event_id}")
    return found


def by_ids(events: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Events of wanted(position, event_id), in that order, repeats kept; unknown ids are left out, or with `strict` raise ValueError."""
    if strict:
        require(wanted, events)
    return wanted.join(events, "event_id").orderBy("position")


def by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)
