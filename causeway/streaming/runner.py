"""The fold over a stream: one keyed state for each group, rows of a micro-batch taken in the order of seq."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.fold import Fold
from causeway.plans.dsl import Composition, Rule, Watch
from causeway.runtime import ship

OUT = "grp string, kind string, derived_id string, rule_id string, event_type string, domain string, ts long, anchor_id string, n_contributors int, depth int, sig string, occurrence long, props string"


def derive_stream(events: DataFrame, rules: list[Rule], key: str, watches: list[Watch] = (), compositions: list[Composition] = ()) -> DataFrame:
    """Derived events, matches and composed events (`kind`) of a streaming events(event_id, event_type, domain, ts, seq), for each
    value of `key`, in append mode. A composed row's rule_id is its composition's, and n_contributors its patterns.

    Order is arrival: by micro-batch, and by seq inside one. Late events are taken like any other, since windows are
    relative to an event's own time; nothing is evicted. Ids depend on nothing but the events of a key and their order,
    so any cut into micro-batches gives the same rows.
    """
    ship(events.sparkSession)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else Fold(list(rules), list(watches), list(compositions))
        rows = pd.concat(list(frames))
        for r in rows.sort_values("seq", kind="stable").to_dict("records"):
            fold.ingest(r["event_id"], r["event_type"], r["domain"], int(r["at"]))
        made = [{"kind": "derived", **d, "n_contributors": len(d["contributors"])} for d in fold.derived]
        made += [{"kind": "match", **m, "sig": f"{m['sig']:016x}", "n_contributors": len(m["contributors"])} for m in fold.matches]
        made += [{"kind": "composed", **c, "rule_id": c["composition_id"], "n_contributors": len(c["patterns"])} for c in fold.composed]
        fold.derived, fold.matches, fold.composed = [], [], []
        state.update((pickle.dumps(fold),))
        out = pd.DataFrame(made, columns=[c.split()[0] for c in OUT.split(", ")])
        out["grp"] = str(group[0])
        yield out.astype({"ts": "Int64", "n_contributors": "Int64", "depth": "Int64", "occurrence": "Int64"})

    rows = events.select(F.col(key).cast("string").alias("grp"), F.col("event_id").cast("string"), "event_type", "domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq")
    return rows.groupBy("grp").applyInPandasWithState(run, OUT, "fold binary", "append", "NoTimeout")


def listen(stream: DataFrame, listeners: Mapping[str, Sequence[Callable[[DataFrame, int], None] | None]]):
    """A writer that hands each micro-batch's rows of a kind to that kind's listeners, one after another, with the batch's number.

    Kinds and their listeners are taken in the order given; a listener that is None is passed over.
    A batch may come again after a failure, as in any foreachBatch; an error of a listener stops the query.
    """

    def hear(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for kind, heard_by in listeners.items():
                for listener in filter(None, heard_by):
                    listener(held.where(F.col("kind") == kind), number)
        finally:
            held.unpersist()

    return stream.writeStream.outputMode("append").foreachBatch(hear)
