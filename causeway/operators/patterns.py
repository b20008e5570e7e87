"""Repeated lineage shapes and their compositions, over ordered derivations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.fold import Fold
from causeway.plans.dsl import Composition, Watch
from causeway.runtime import ship, staged


def watch(derived: DataFrame, spec: Watch, order: str) -> DataFrame:
    """Rows of derived(derived_type, derived_domain, sig, ...) at which a shape has occurred min_count times or more, with the occurrence."""
    rows = derived
    for column, allowed in (("derived_type", spec.types), ("derived_domain", spec.domains)):
        if allowed is not None:
            rows = rows.where(F.col(column).isin(*allowed) if allowed else F.lit(False))
    if not 1 <= spec.depth <= 5:
        rows = rows.where(F.lit(False))
    w = Window.partitionBy("derived_type", "derived_domain", "sig").orderBy(order)
    return rows.withColumn("occurrence", F.row_number().over(w).cast("long")).where(F.col("occurrence") >= spec.min_count)


def compose(matches: DataFrame, spec: Composition, order: str, partition: str | None = None) -> DataFrame:
    """Matches (derived_type, derived_domain, ts, derived_id) at which the composition fires, with the latest match of each pattern.

    Adds p_0, p_1, ... in the order of spec.required. The clock is the time of the match that triggers; matches are
    taken in the order of `order`, a total one that follows their times. The matches are cut into ranges of it, and a
    range starts from the last matches of each pattern before it, as many as that pattern needs. What fires with
    reset_on_fire depends on all that fired before, so then a partition (or, without one, everything) is one group.
    """
    ship(matches.sparkSession)
    kinds = list(spec.required)
    if len({"kind", "chunk", "at"} & set(matches.columns)):
        raise ValueError("matches must not have columns kind, chunk or at")
    which = F.coalesce(*[F.when((F.col("derived_type") == t) & (F.col("derived_domain") == d), F.lit(i)) for i, (t, d) in enumerate(kinds)])
    rows = matches.withColumn("kind", which).where("kind is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    before: dict[int, list[tuple]] = {}
    if partition or spec.reset_on_fire:
        rows = rows.withColumn("chunk", F.col(partition) if partition else F.lit(0))
    else:
        rows = staged(rows.repartitionByRange(order).withColumn("chunk", F.spark_partition_id()), "matches")
        needs = F.element_at(F.array(*[F.lit(max(1, n)) for n in spec.required.values()]), F.col("kind") + 1)
        late = rows.withColumn("back", F.row_number().over(Window.partitionBy("chunk", "kind").orderBy(F.desc(order)))).where(F.col("back") <= needs)
        # bounded: so many rows a range and pattern as the pattern needs
        for r in late.select("chunk", "kind", "at", "derived_id", F.col(order).alias("o")).orderBy("o").collect():
            before.setdefault(r["chunk"], []).append((r["kind"], r["at"], r["derived_id"]))
    carried: dict[int, list[tuple]] = {}
    held: dict[int, list[tuple]] = {}
    for chunk in sorted(before):
        carried[chunk] = [x for k in sorted(held) for x in held[k]]
        for x in before[chunk]:
            held.setdefault(x[0], []).append(x)
        held = {k: v[-max(1, spec.required[kinds[k]]) :] for k, v in held.items()}
    names = [f"p_{i}" for i in range(len(kinds))]
    kept = [c for c in rows.columns if c not in ("kind", "at", "chunk")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state = Fold([], [], [spec])
        for k, at, derived_id in carried.get(frame["chunk"].iloc[0], []):
            state.recent[spec.composition_id, kinds[k]].append((at, derived_id))
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        fired = []
        for i, (k, at, derived_id) in enumerate(zip(frame["kind"], frame["at"], frame["derived_id"], strict=True)):
            state.compose(spec, {"event_type": kinds[k][0], "domain": kinds[k][1], "ts": int(at), "derived_id": derived_id})
            if len(state.composed) > len(fired):
                fired.append(i)
        out = frame.loc[fired, kept].reset_index(drop=True)
        for i, name in enumerate(names):
            out[name] = pd.Series([c["patterns"][i] for c in state.composed], dtype=object)
        return out

    schema = rows.select(*kept)
    for name in names:
        schema = schema.withColumn(name, F.lit(None).cast("string"))
    return rows.groupBy("chunk").applyInPandas(run, schema.schema)
