"""Text report of a graph by derivation level, and matches as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.relations import derivation_levels


def report(events: DataFrame, edges: DataFrame) -> DataFrame:
    """One line for each event: level (highest first when ordered), event, and its contributors."""
    levels = derivation_levels(events.select("event_id"), edges)
    below = edges.groupBy(F.col("to_id").alias("event_id")).agg(F.array_join(F.sort_array(F.collect_list("from_id")), ", ").alias("contributors"))
    return events.join(levels, "event_id").join(below, "event_id", "left").select("level", "event_id", "event_type", "domain", "contributors").orderBy(F.desc("level"), "event_id")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
