"""Relations of a graph that are asked for again and again: each is worked out once and kept until events or edges are added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import conditions, relations
from causeway.plans.dsl import Options
from causeway.runtime import discard, staged
from causeway.sources import model


class CachedRelations:
    """A graph whose relations are written to the shared folder when first asked for.

    What is kept is the relation of a set of anchors, unfiltered, so that questions which differ in type, window or
    properties only share it. Adding to the graph drops all of it: a relation may reach anywhere.
    """

    def __init__(self, events: DataFrame, edges: DataFrame):
        self.events, self.edges, self.revision = events, edges, 0
        self._kept: dict[tuple, list[tuple[DataFrame, DataFrame]]] = {}

    def add_event(self, new: DataFrame) -> None:
        self.events = model.add_event(self.events, new)
        self.forget()

    def add_edges(self, new: DataFrame) -> None:
        """ValueError if an end of a new edge is missing; then nothing changes."""
        self.edges = model.add_edges(self.edges, new, self.events)
        self.forget()

    def forget(self) -> None:
        """Drop and delete what is kept; frames got from here before can't be read any more."""
        self.revision += 1
        for kept in self._kept.values():
            discard(*[found for _, found in kept])
        self._kept.clear()

    def related(self, relation: str, anchors: DataFrame, event_type: str = "", options: Options | None = None) -> DataFrame:
        """(anchor_id, event_id) of children, parents, ancestors, descendants, siblings, cousins or peers of anchors(anchor_id).

        `event_type` "" stands for any; the window reaches backwards from the anchor. Ancestors are not filtered. The
        options' depth, 1 if it is 0, tells how far ancestors, descendants and cousins reach. An unknown anchor has no rows.
        """
        options = options or Options()
        found = self._whole(relation, anchors, options.depth or 1)
        if relation == "ancestors" or not event_type and options.window is None and not options.props:
            return found
        asked = anchors.select(F.col("anchor_id").alias("event_id")).distinct()
        own = self.events.join(asked, "event_id", "left_semi").withColumnRenamed("event_id", "anchor_id")
        pairs = conditions.known(found, own, self.events)
        return conditions.filtered(pairs, event_type, options.window, options.props).select("anchor_id", "event_id")

    def _whole(self, relation: str, anchors: DataFrame, depth: int) -> DataFrame:
        ids = anchors.select("anchor_id")
        key = relation, depth if relation in ("ancestors", "descendants", "cousins") else 0, ids.semanticHash()
        for asked, found in self._kept.get(key, []):
            if asked.sameSemantics(ids):
                return found
        ask = {
            "children": lambda: relations.children(ids, self.edges),
            "parents": lambda: relations.parents(ids, self.edges),
            "ancestors": lambda: relations.ancestors(ids, self.edges, depth).select("anchor_id", "event_id"),
            "descendants": lambda: relations.contributors_closure(ids, self.edges, depth),
            "siblings": lambda: relations.siblings(ids, self.edges),
            "cousins": lambda: relations.cousins(ids, self.edges, depth),
            "peers": lambda: relations.peers(ids, self.events, self.edges),
        }
        found = staged(ask[relation](), relation)
        self._kept.setdefault(key, []).append((ids, found))
        return found
