"""Derivation of events by rules: closed forms where consumption is plain counting, keyed folds elsewhere."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from causeway.operators.conditions import truth
from causeway.operators.fold import Fold
from causeway.plans.dsl import Composition, Rule, Watch
from causeway.runtime import lean, ship

#: Rows of one Arrow batch that a fold hands back.
BATCH = 4096
DERIVED = "grp string, derived_id string, rule_id string, event_type string, domain string, ts long, root_id string, place int, anchor_id string, n_contributors int, props string, contributors array<string>"


def by_count(events: DataFrame, n: int, keys: tuple[str, ...] = ("event_type", "domain")) -> DataFrame:
    """All events with the group that HasPeers(own type, n) makes of them, when no other rule consumes their type.

    The pool of free events grows by one an event and empties when it fires, so every (n + 1)th event of a type and
    domain fires, and exact and or-more counts are the same. Adds `grp` (from 1), `at` (1 to n + 1) and `fires`.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    numbered = events.withColumn("rn", F.row_number().over(w).cast("long"))
    return numbered.select("*", (F.floor((F.col("rn") - 1) / (n + 1)) + 1).alias("grp"), ((F.col("rn") - 1) % (n + 1) + 1).alias("at")).withColumn("fires", F.col("at") == n + 1)


def derived_by_count(events: DataFrame, n: int, keys: tuple[str, ...] = ("event_type", "domain")) -> DataFrame:
    """One row for each firing: the keys, grp, ts (latest contributor's), fired_seq, n_contributors."""
    return by_count(events, n, keys).groupBy(*keys, "grp").agg(F.max("ts").alias("ts"), F.max("seq").alias("fired_seq"), F.count("*").alias("n_contributors")).where(F.col("n_contributors") == n + 1)


def stateless(events: DataFrame, rule: Rule) -> DataFrame:
    """What a rule without relational terms derives: (event_id, event_type, domain, ts, anchor_id, props), a filter and nothing else."""
    fires = events.where(F.col("event_type").isin(*rule.triggers) & truth(rule.condition))
    name = F.concat_ws(":", F.lit(rule.rule_id), F.col("event_id").cast("string"))
    return fires.select(name.alias("event_id"), F.lit(rule.event_type).alias("event_type"), F.lit(rule.domain).alias("domain"), "ts", F.col("event_id").alias("anchor_id"), F.lit(json.dumps(dict(rule.props), sort_keys=True, default=str)).alias("props"))


def clusters(rules: list[Rule]) -> list[list[Rule]]:
    """Rules that share a type they read, trigger on or make; rules of different clusters never affect each other."""
    groups: list[tuple[set[str], list[Rule]]] = []
    for rule in rules:
        types = {*rule.triggers, rule.event_type, *[t.value for t in rule.condition.terms() if isinstance(t.value, str) and t.kind not in ("type", "domain")]}
        touched = [g for g in groups if g[0] & types]
        groups = [g for g in groups if not g[0] & types]
        groups.append((types.union(*[g[0] for g in touched]), [r for g in touched for r in g[1]] + [rule]))
    return [sorted(g[1], key=rules.index) for g in groups]


def fold(events: DataFrame, rules: list[Rule], watches: list[Watch] = (), compositions: list[Composition] = (), key: str | None = None, props: tuple[str, ...] = (), what: str = "derived") -> DataFrame:
    """What rules derive from events(event_id, event_type, domain, ts, seq) taken in the order of seq.

    Each cluster of rules is a group of its own; with `key`, so is each value of that column, which means one graph for
    each value instead of one for all. Compositions and rules with a process of their own tie all rules into one cluster.
    `what`: derived, matches, composed, or the graph that came of it: events (derived and composed ones) or edges.
    """
    ship(events.sparkSession)
    parts = [list(rules)] if compositions or any(r.process for r in rules) else clusters(rules)
    of = {t: i for i, part in enumerate(parts) for r in part for t in (*r.triggers, *[x.value for x in r.condition.terms() if x.kind not in ("type", "domain", "any_type")])}
    if not of:
        raise ValueError("no rules")
    cluster = F.lit(0) if len(parts) == 1 and any(r.process for r in rules) else F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i)) for t, i in of.items()])
    rows = events.select(F.concat_ws("/", cluster.cast("string"), F.col(key).cast("string") if key else F.lit("")).alias("grp"), cluster.alias("cluster"), F.col("event_id").cast("string"), "event_type", "domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", *props).where("cluster is not null")
    # a group costs far more than its bytes tell, so the number of partitions is named, else small ones would be put together
    rows = rows.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp", "seq")

    schema = {
        "derived": DERIVED,
        "matches": "grp string, event_type string, domain string, depth int, sig string, occurrence long, ts long, derived_id string, rule_id string, n_contributors int",
        "composed": "grp string, composition_id string, event_type string, domain string, ts long, derived_id string, props string, patterns array<string>",
        "events": "grp string, event_id string, event_type string, domain string, ts long, props string",
        "edges": "grp string, from_id string, to_id string, relation string",
    }[what]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def made(grp: str, state: Fold) -> list[dict]:
        if what == "edges":
            out = [{"from_id": c, "to_id": d["derived_id"], "relation": "trigger"} for d in state.derived for c in d["contributors"]]
            out += [{"from_id": c, "to_id": d["derived_id"], "relation": "pattern_composition"} for d in state.composed for c in d["patterns"] if c in state.events]
        elif what == "events":
            out = [{**d, "event_id": d["derived_id"]} for d in (*state.derived, *state.composed)]
        else:
            out = {"derived": state.derived, "matches": state.matches, "composed": state.composed}[what]
        for d in out:
            d["grp"] = grp
            if "contributors" in d:
                d["n_contributors"] = len(d["contributors"])
            if "sig" in d:
                d["sig"] = f"{d['sig']:016x}"
        return out

    def run(batches):
        """The groups of a partition, one after another, as their rows come."""
        state, grp, out = None, None, []
        for batch in batches:
            for g, cluster, event_id, event_type, domain, ts, *held in zip(*batch.to_pydict().values(), strict=True):
                if g != grp:
                    if state is not None:
                        out += made(grp, state)
                    grp, state = g, Fold(parts[cluster], watches, compositions)
                    for i in range(0, len(out) - BATCH + 1, BATCH):
                        yield pa.RecordBatch.from_pylist(out[i : i + BATCH], arrow)
                    out = out[len(out) // BATCH * BATCH :]
                state.ingest(event_id, event_type, domain, ts, dict(zip(props, held, strict=True)))
        if state is not None:
            out += made(grp, state)
        for i in range(0, len(out), BATCH):
            yield pa.RecordBatch.from_pylist(out[i : i + BATCH], arrow)

    return rows.select("grp", "cluster", "event_id", "event_type", "domain", "ts", *props).mapInArrow(lean(run), schema)
