"""Relations, conditions, folds and compositions on small graphs with known results."""

import random
from datetime import datetime, timedelta

import pytest

from causeway.functions.time_units import micros
from causeway.operators import conditions, derive, relations
from causeway.operators.fold import Fold
from causeway.plans.dsl import Composition, Condition, Rule, Watch

HOUR, DAY = micros(1, "hour"), micros(1, "day")
T0 = datetime(2026, 1, 1, 9)


def at(**k):
    return int(timedelta(**k) / timedelta(microseconds=1))


@pytest.fixture(scope="module")
def infra(spark):
    names = [("c1", "cpu"), ("c2", "cpu"), ("c3", "cpu"), ("m1", "memory"), ("m2", "memory"), ("m3", "memory"), ("CC", "cpu_critical"), ("MC", "memory_critical"), ("SN", "server")]
    events = spark.createDataFrame([(n, t, "infra", T0 + timedelta(milliseconds=i), i, "critical" if t in ("cpu", "memory") else None) for i, (n, t) in enumerate(names)], "event_id string, event_type string, domain string, ts timestamp, seq long, level string").cache()
    edges = spark.createDataFrame([(a, b, "trigger") for a, b in [("c1", "CC"), ("c2", "CC"), ("c3", "CC"), ("m1", "MC"), ("m2", "MC"), ("m3", "MC"), ("MC", "SN"), ("CC", "SN")]], "from_id string, to_id string, relation string").cache()
    return events, edges


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_relations(spark, infra):
    events, edges = infra
    a = lambda x: spark.createDataFrame([(x,)], "anchor_id string")
    assert ids(relations.children(a("CC"), edges)) == ["c1", "c2", "c3"]
    assert ids(relations.siblings(a("c1"), edges)) == ["c2", "c3"]
    assert len(ids(relations.contributors_closure(a("SN"), edges, 2))) == 8
    assert ids(relations.cousins(a("CC"), edges, 1)) == ["MC"]
    assert len(ids(relations.cousins(a("m1"), edges, 2))) == 5
    assert ids(relations.ancestors(a("c1"), edges, 2)) == ["CC", "SN"]
    assert ids(relations.ancestors(a("c1"), edges, 0)) == []
    levels = {r["event_id"]: r["level"] for r in relations.derivation_levels(events, edges).collect()}
    assert levels["c1"] == 0 and levels["CC"] == 1 and levels["SN"] == 2


def graph_fold(infra):
    f = Fold([])
    for r in infra[0].orderBy("seq").collect():
        f.add(r["event_id"], r["event_type"], r["domain"], r["seq"] * 1000, {"level": r["level"]})
    for r in infra[1].collect():
        f.link(r["from_id"], r["to_id"])
    return f


CASES = [
    ("CC", Condition().has_child("cpu", how_many=3), True, 3),
    ("CC", Condition().has_descendants("cpu"), False, 0),
    ("c1", Condition().has_descendants("cpu_critical"), True, 1),
    ("MC", Condition().has_child("memory", props={"level": "critical"}), True, 3),
    ("MC", Condition().has_child("memory", props={"other": "x"}), False, 0),
    ("c1", Condition().has_siblings("cpu", how_many=10), False, 2),
    ("m1", Condition().has_cousin("cpu", depth=2), True, 3),
    ("m1", Condition().has_cousin("cpu"), False, 0),
    ("SN", Condition().group().has_child("cpu_critical").or_().has_child("memory_critical").ungroup().and_().is_type("server"), True, 2),
    ("CC", Condition().has_cousin("memory_critical", depth=1), True, 1),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_conditions_snapshot_and_fold_agree(infra, i):
    anchor, condition, ok, n = CASES[i]
    got, found = graph_fold(infra).holds(condition, anchor)
    assert (got, len(found)) == (ok, n)
    if i in (0, 5, 8):
        events, edges = infra
        row = conditions.evaluate(condition, events.where(f"event_id = '{anchor}'").withColumnRenamed("event_id", "anchor_id"), events, edges)[0].first()
        assert (row["ok"], row["n_matched"]) == (ok, n)


@pytest.mark.parametrize("condition, message", [(Condition(), "empty expression"), (Condition().group().is_type("x"), "mismatched parentheses"), (Condition().is_type("x").ungroup(), "mismatched parentheses"), (Condition().is_type("x").and_(), "invalid expression"), (Condition().is_type("x").is_type("y"), "did not collapse")])
def test_parser_errors(condition, message):
    with pytest.raises(ValueError, match=message):
        condition.postfix()


def peers(*types, window=None, n=1, or_more=True):
    c = Condition()
    for i, t in enumerate(types):
        c = (c.or_() if i else c).has_peers(t, how_many=n, or_more=or_more, window=window)
    return c


def test_infra_cascade():
    rules = [Rule("1", ("c",), peers("c", n=2, or_more=False), "CC", "d"), Rule("2", ("m",), peers("m", n=2, or_more=False), "MC", "d"), Rule("3", ("CC", "MC"), peers("CC", "MC"), "SN", "d")]
    f = Fold(rules, [Watch(4, 1)])
    for i, t in enumerate("c m c c m m c c m c m m".split()):
        f.ingest(f"{t}{i}", t, "d", i)
    assert [d["event_type"] for d in f.derived] == ["CC", "MC", "SN", "CC", "MC", "SN"]
    assert [m["occurrence"] for m in f.matches] == [1, 1, 1, 2, 2, 2]
    assert len(f.events) == 18 and sum(map(len, f.down.values())) == 16


def ladder_b():
    day7, w = 7 * DAY, "window"
    rules = [
        Rule("1", ("V", "P"), Condition().has_peers("V", how_many=2, or_more=True, window=DAY).or_().has_peers("P", how_many=1, or_more=True, window=DAY), "CVC", "customization"),
        Rule("2", ("RB",), peers("RB", **{w: day7}), "BSC", "eval"),
        Rule("3", ("BSC", "CVC"), peers("BSC", "CVC", window=day7), "ADS", "meta"),
        Rule("4", ("ADS", "CEJ"), peers("ADS", "CEJ", window=2 * day7), "CAD", "meta"),
        Rule("5", ("CAD", "TPBG", "SCS"), peers("CAD", "TPBG", "SCS", window=3 * day7), "UTR", "product"),
        Rule("6", ("UTR", "GOR"), peers("UTR", "GOR", window=2 * DAY), "DHR", "governance"),
    ]
    leaves = [("V", "values", at(minutes=30)), ("P", "customization", at(hours=3)), ("V", "values", at(hours=10)), ("RB", "eval", at(days=2)), ("RB", "eval", at(days=5)), ("CEJ", "eval", at(days=6)), ("TPBG", "external", at(days=7)), ("SCS", "product", at(days=8)), ("GOR", "governance", at(days=8, hours=6))]
    return rules, leaves


def test_five_level_ladder_with_composition():
    rules, leaves = ladder_b()
    watches = [Watch(5, 2, frozenset({"DHR"})), Watch(4, 2, frozenset({"ADS"}))]
    f = Fold(rules, watches, [Composition("review", {("DHR", "governance"): 1, ("ADS", "meta"): 1}, "session", "governance", 30 * DAY)])
    for r in range(3):
        for i, (t, d, offset) in enumerate(leaves):
            f.ingest(f"{t}-{r}-{i}", t, d, r * 5 * DAY + offset)
    counts = {t: sum(d["event_type"] == t for d in f.derived) for t in ("CVC", "BSC", "ADS", "CAD", "UTR", "DHR")}
    assert counts == {"CVC": 3, "BSC": 3, "ADS": 3, "CAD": 3, "UTR": 4, "DHR": 3}
    assert sorted((m["event_type"], m["occurrence"]) for m in f.matches) == [("ADS", 2), ("ADS", 3), ("DHR", 2)]
    assert len(f.composed) == 1 and len(f.events) == 47 and sum(map(len, f.down.values())) == 43
    assert sorted(len(d["contributors"]) for d in f.derived if d["event_type"] == "CVC") == [3, 3, 3]


def test_cross_domain_rounds():
    base = datetime(2026, 4, 25)
    tremors = [(25, 5, 11), (25, 6, 17), (2, 6, 18), (25, 6, 44), (25, 7, 21), (25, 7, 5), (25, 12, 23), (25, 12, 53)]
    when = lambda d, h, m: at(days=d, hours=h, minutes=m)
    rules = [Rule("1", ("zebra", "bird"), peers("bird", "zebra", window=8 * HOUR), "MA", "animal"), Rule("2", ("tremor",), peers("tremor", n=5, window=8 * HOUR), "HF", "geology"), Rule("3", ("HF", "MA"), peers("HF", "MA", window=8 * HOUR), "PC", "warning")]
    f = Fold(rules, [Watch(4, 3)])
    assert base
    for r in range(3):
        f.ingest(f"z{r}", "zebra", "animal", when(25, 5, 3))
        f.ingest(f"b{r}", "bird", "animal", when(25, 13, 3))
        for i, t in enumerate(tremors):
            f.ingest(f"t{r}-{i}", "tremor", "geology", when(*t))
        assert {t: sum(d["event_type"] == t for d in f.derived) for t in ("MA", "HF", "PC")} == {"MA": r + 1, "HF": r + 1, "PC": r + 1}
    assert len(f.events) == 39 and sum(map(len, f.down.values())) == 30
    assert sorted(m["event_type"] for m in f.matches) == ["HF", "MA", "PC"]


@pytest.mark.parametrize("times, window, needs, fires", [([("A", 0), ("T", 30)], 60, (1, 1), [0, 1]), ([("A", 0), ("T", 120)], 60, (1, 1), [0, 0]), ([("A", 0), ("T", 0), ("A", 0)], 1440, (2, 1), [0, 0, 1]), ([("A", 0), ("T", 2880)], None, (1, 1), [0, 1]), ([("X", 0)], None, (1, 1), [0])])
def test_compositions(times, window, needs, fires):
    c = Composition("c", {("A", "a"): needs[0], ("T", "a"): needs[1]}, "R", "r", None if window is None else window * micros(1, "minute"))
    f, got = Fold([], [], [c]), []
    for i, (t, minute) in enumerate(times):
        f.compose(c, {"event_type": t, "domain": "a", "ts": minute * micros(1, "minute"), "derived_id": f"x{i}"})
        got.append(len(f.composed))
    assert got == fires


def test_signature_constant(spark):
    from pyspark.sql import functions as F

    from causeway.functions import fnv

    row = spark.range(1).select(fnv.base_signature(F.lit("cpu_critical"), F.lit("infra_domain")).alias("s"), fnv.lineage_signature(2, F.lit(5).cast("long"), F.array(F.lit(-1).cast("long"), F.lit(3).cast("long"))).alias("t")).first()
    assert row["s"] == 5448318806342686982
    assert row["t"] % (1 << 64) == Fold._lineage(2, 5, [(1 << 64) - 1, 3])


def test_closed_form_equals_fold(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.choice("ab"), rng.choice("xy"), T0 + timedelta(seconds=i), i) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, domain string, ts timestamp, seq long")
    rules = [Rule(t, (t,), Condition().has_peers(t, how_many=2), t.upper(), "d") for t in "ab"]
    folded = {r["anchor_id"]: r["n_contributors"] for r in derive.fold(events.repartition(3), rules).collect()}
    closed = {str(r["fired_seq"]): r["n_contributors"] for r in derive.derived_by_count(events.repartition(5), 2).collect()}
    assert folded == closed


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_stream_equals_batch(spark, tmp_path, batches):
    from causeway.streaming.runner import derive_stream

    rows = [(str(i), "a", "x" if i % 3 else "y", T0 + timedelta(seconds=i), i) for i in range(42)]
    schema = "event_id string, event_type string, domain string, ts timestamp, seq long"
    rules = [Rule("r", ("a",), Condition().has_peers("a", how_many=2, or_more=True, window=micros(30, "second")), "A", "d")]
    watches, compositions = [Watch(1, 2)], [Composition("c", {("A", "d"): 2}, "C", "e", micros(60, "second"))]
    size = -(-len(rows) // batches)
    for part in range(batches):
        spark.createDataFrame(rows[part * size : part * size + size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"derived_stream_{batches}"
    query = derive_stream(stream, rules, "domain", watches, compositions).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    events = spark.createDataFrame(rows, schema)
    for kind, what in (("derived", "derived"), ("match", "matches"), ("composed", "composed")):
        got = sorted((r["derived_id"], r["ts"], r["n_contributors"]) for r in spark.table(name).where(f"kind = '{kind}'").collect())
        batch = derive.fold(events, rules, watches, compositions, key="domain", what=what).collect()
        # the fold's key stands in the state only, so ids are those of the batch
        want = sorted((r["derived_id"], r["ts"], len(r["patterns"]) if kind == "composed" else r["n_contributors"]) for r in batch)
        assert got == want and want


def test_listeners(spark, tmp_path):
    from causeway.streaming.runner import derive_stream, listen

    schema = "event_id string, event_type string, domain string, ts timestamp, seq long"
    spark.createDataFrame([(str(i), "a", "x", T0 + timedelta(seconds=i), i) for i in range(9)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = [Rule("r", ("a",), peers("a", n=2), "A", "d")]
    heard = []
    hear = lambda name: lambda rows, number: heard.append((name, number, rows.count()))
    out = derive_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, "domain", [Watch(1, 2)])
    query = listen(out, {"derived": [hear("one"), hear("two")], "match": [hear("match")]}).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert heard == [("one", 0, 3), ("two", 0, 3), ("match", 0, 2)]


def test_windowed_peers_by_brute_force():
    rng = random.Random(5)
    events = [(str(i), rng.choice("ab"), rng.choice("xy"), rng.randrange(0, 200)) for i in range(300)]
    rules = [Rule("1", ("a", "b"), peers("a", "b", window=7), "A", "d")]
    f, free, want = Fold(rules), {}, []
    for i, (name, t, d, ts) in enumerate(events):
        f.ingest(name, t, d, ts)
        free[name] = (t, d, ts)
        found = [e for kind in "ab" for e, (u, v, x) in free.items() if u == kind and e != name and (u != t or v == d) and abs(x - ts) <= 7]
        if found:
            want.append((name, [*found, name]))
            for e in (*found, name):
                free.pop(e, None)
    assert [(x["anchor_id"], x["contributors"]) for x in f.derived] == want and want


@pytest.mark.parametrize("window, reset", [(None, False), (5, False), (5, True), (0, False)])
def test_composition_after_the_fact_equals_fold(spark, window, reset):
    from causeway.operators import patterns

    rng, ts, rows = random.Random(7), 0, []
    for i in range(200):
        ts += rng.choice([0, 0, 1, 3])
        rows.append((rng.choice("ATX"), "a", T0 + timedelta(seconds=ts), f"m{i}", i))
    spec = Composition("c", {("A", "a"): 2, ("T", "a"): 1}, "R", "r", None if window is None else window * micros(1, "second"), reset)
    f, want = Fold([], [], [spec]), []
    for t, d, when, name, _ in rows:
        before = len(f.composed)
        f.compose(spec, {"event_type": t, "domain": d, "ts": int((when - T0) / timedelta(microseconds=1)), "derived_id": name})
        if len(f.composed) > before:
            want.append((name, *f.composed[-1]["patterns"]))
    matches = spark.createDataFrame(rows, "derived_type string, derived_domain string, ts timestamp, derived_id string, o long").repartition(3)
    got = sorted((tuple(r) for r in patterns.compose(matches, spec, "o").select("derived_id", "p_0", "p_1").collect()), key=lambda r: int(r[0][1:]))
    assert got == want and want


def test_peer_counts_equal_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", None]), T0 + timedelta(seconds=rng.randrange(100)), i, rng.choice(["1", "2"]), rng.choice([1, 2])) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, domain string, ts timestamp, seq long, word string, k int")
    edges = spark.createDataFrame([(3, 7, "trigger"), (8, 9, "trigger")], "from_id long, to_id long, relation string")
    anchors = events.withColumnRenamed("event_id", "anchor_id")
    for window in (None, 0, 4 * micros(1, "second"), 50 * micros(1, "second")):
        for props in ({}, {"k": 1}, {"word": 1}):
            term = Condition().has_peers("a", how_many=1, window=window, props=props)
            ok, found = conditions.evaluate(term, anchors, events, edges)
            want = {r["anchor_id"]: r["n"] for r in found.groupBy("anchor_id").agg(F.count("*").alias("n")).collect()}
            assert {r["anchor_id"]: r["n_matched"] for r in ok.where("n_matched <> 0").collect()} == want
            assert bool(want) == (props != {"word": 1})


def test_unknown_ids_and_cycles(spark, infra):
    from causeway.sources import model

    events, edges = infra
    wanted = spark.createDataFrame([(0, "c1"), (1, "lost")], "position long, event_id string")
    assert ids(model.by_ids(events, wanted)) == ["c1"]
    with pytest.raises(ValueError, match="event not found: lost"):
        model.by_ids(events, wanted, strict=True)
    with pytest.raises(ValueError, match="event not found"):
        model.by_id(events, "lost", strict=True)
    with pytest.raises(ValueError, match="from/to event not found"):
        model.add_edges(edges, spark.createDataFrame([("c1", "lost", "manual")], edges.schema), events)
    circle = spark.createDataFrame([("c1", "c2", "t"), ("c2", "c1", "t")], edges.schema)
    with pytest.raises(ValueError, match="cycle"):
        relations.derivation_levels(events.where("event_id in ('c1', 'c2')"), circle)


def test_validation_of_all_edges(spark, tmp_path):
    import duckdb

    from causeway import queries

    day = datetime(2026, 1, 1).date()
    tables = {
        "lineitem": ([(1, 1, 1, 1, day), (3, 1, 1, 1, day), (9, 1, 1, 1, day)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date"),
        "orders": ([(1, 1), (3, 8)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 1), (2, 7)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, 1), (2, 6)], "n_nationkey int, n_regionkey int"),
        "region": ([(1,)], "r_regionkey int"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = {(r["from_id"][:4], r["to_id"]) for r in queries.queries()["add_edge_validation"](spark, str(tmp_path)).collect()}
    assert got == {("l:9:", "o:9"), ("o:3", "c:8"), ("c:2", "n:7"), ("n:2", "r:6")}
    assert {(a[:4], b) for a, b in db.execute(queries.oracle_sql()["add_edge_validation"]).fetchall()} == got


def test_cached_relations(spark, infra):
    from causeway.operators.cache import CachedRelations
    from causeway.plans.dsl import Options

    events, edges = infra
    a = lambda *x: spark.createDataFrame([(i,) for i in x], "anchor_id string")
    view, both = CachedRelations(events, edges), a("c1", "CC")
    first = view.related("siblings", both)
    assert ids(first) == ["MC", "c2", "c3"] and view.related("siblings", both) is first
    assert ids(view.related("siblings", both, "cpu")) == ["c2", "c3"]
    assert ids(view.related("children", a("CC"), "", Options(props={"level": "critical"}))) == ["c1", "c2", "c3"]
    assert ids(view.related("children", a("MC"), "cpu")) == []
    assert ids(view.related("parents", a("c1"))) == ["CC"] and ids(view.related("peers", a("c1"))) == []
    assert ids(view.related("ancestors", a("c1"), options=Options(depth=2))) == ["CC", "SN"]
    assert len(ids(view.related("descendants", a("SN"), options=Options(depth=2)))) == 8
    assert ids(view.related("cousins", a("CC"))) == ["MC"] and ids(view.related("children", a("lost"))) == []
    with pytest.raises(ValueError, match="from/to event not found"):
        view.add_edges(spark.createDataFrame([("c9", "CC", "manual")], edges.schema))
    assert view.related("siblings", both) is not None and view.revision == 0
    view.add_event(spark.createDataFrame([("c9", "cpu", "infra", T0, 99, None)], events.schema))
    view.add_edges(spark.createDataFrame([("c9", "CC", "manual")], edges.schema))
    assert ids(view.related("siblings", both)) == ["MC", "c2", "c3", "c9"] and view.revision == 2


def test_corpus_part_is_optional(monkeypatch):
    import importlib

    import __spark_entry__ as entry
    from causeway import queries

    def without(missing):
        def load(name, real=importlib.import_module):
            if name in ("causeway.llm.queries", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)
            return real(name)

        monkeypatch.setattr(entry.importlib, "import_module", load)

    without("causeway.llm")
    assert set(entry.queries()) == set(queries.queries()) and set(entry.oracle_sql()) == set(queries.oracle_sql())
    without("somelib")
    with pytest.warns(UserWarning, match="somelib"):
        assert set(entry.queries()) == set(queries.queries())


def test_greedy_sql_equals_fold(spark, tmp_path):
    import duckdb

    from causeway import queries

    rng = random.Random(3)
    rows = [(i, rng.choice(["click", "error", "purchase", "view"]), rng.randrange(3), T0 + timedelta(hours=rng.randrange(900)), 1.0, '{"k": 1}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts timestamp, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("derive_windowed_greedy", "derive_cross_type_pair", "watch_fold"):
        got = queries.queries()[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want) and want


def moved(spark, run):
    """Rows that run() shuffles or writes."""
    context = spark.sparkContext._jsc.sc()
    sides = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, sides, spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def as_edges(spark, pairs):
    return spark.createDataFrame([(a, b, "t") for a, b in pairs], "from_id string, to_id string, relation string").cache()


def as_anchors(spark, names):
    return spark.createDataFrame([(x,) for x in names], "anchor_id string").cache()


@pytest.fixture(scope="module")
def star(spark):
    """150 line items of 3 orders of one customer, whose nation and region follow."""
    lines = [f"l{i}" for i in range(150)]
    return as_anchors(spark, lines), as_edges(spark, [*[(x, f"o{i % 3}") for i, x in enumerate(lines)], *[(f"o{i}", "c") for i in range(3)], ("c", "n"), ("n", "r")])


def trade_folder(tmp_path, orders, lines):
    """Tables orders (key, customer) and lineitem (order), with customers, a nation and a region, as DuckDB views too."""
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    rows = lambda r: ", ".join(map(str, r))
    made = {
        "orders": f"SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey FROM (VALUES {rows(orders)}) t(o_orderkey, o_custkey)",
        "lineitem": f"SELECT k::BIGINT AS l_orderkey, i::INTEGER AS l_linenumber, i::BIGINT AS l_partkey, i::BIGINT AS l_suppkey, TIMESTAMP '2000-01-01' AS l_shipdate FROM (VALUES {rows(enumerate(lines))}) t(i, k)",
        "customer": f"SELECT DISTINCT c::BIGINT AS c_custkey, 1 AS c_nationkey FROM (VALUES {', '.join(f'({c})' for _, c in orders)}) t(c)",
        "nation": "SELECT 1 AS n_nationkey, 0 AS n_regionkey",
        "region": "SELECT 0 AS r_regionkey",
    }
    for name, sql in made.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return db


def agrees(spark, db, folder, name):
    """A query's rows, after they were found to be those of its SQL."""
    from causeway import queries

    got = queries.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    key = lambda row: [(x is None, x) for x in row]
    rows = sorted(map(tuple, got.select(*columns).collect()), key=key)
    assert rows == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=key)
    return rows


def test_kin_by_brute_force(spark):
    up = lambda s, e: {b for a, b in e if a in s}
    down = lambda s, e: {a for a, b in e if b in s}

    def levels(a, e, depth):
        seen, front, out = {a}, {a}, []
        for _ in range(depth):
            front = up(front, e) - seen
            seen |= front
            out.append(front)
        return out

    def cousins(a, e, depth):
        out = set()
        for i, level in enumerate(levels(a, e, depth)):
            for _ in range(i + 1):
                level = down(level, e)
            out |= level
        return out - {a}

    rng, names = random.Random(5), [f"e{i}" for i in range(14)]
    for kind, depth in (("forest", 2), ("forks", 3), ("cycles", 2)):
        pairs = [(x, rng.choice(names[i + 1 :])) for i, x in enumerate(names[:-1]) if rng.random() < 0.9]
        pairs += {"forest": [], "forks": [("e1", "e9"), ("e0", "e12"), *pairs[:2]], "cycles": [("e13", "e2"), ("e5", "e5"), ("e4", "e3")]}[kind]
        edges, anchors, e, asked = as_edges(spark, pairs), as_anchors(spark, [*names, "e3", "nobody"]), set(pairs), [*names, "nobody"]
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(relations.ancestors(anchors, edges, depth)) == sorted((a, x, i + 1) for a in asked for i, level in enumerate(levels(a, e, depth)) for x in level)
        assert rows(relations.ancestor_levels(anchors, edges, depth)) == sorted((a, i + 1, len(level), max(level)) for a in asked for i, level in enumerate(levels(a, e, depth)) if level)
        siblings = {a: down(up({a}, e), e) - {a} for a in asked}
        assert rows(relations.siblings(anchors, edges)) == sorted((a, x) for a in asked for x in siblings[a])
        for without in (False, True):
            kin = {a: cousins(a, e, depth) - (siblings[a] if without else set()) for a in asked}
            assert rows(relations.cousin_counts(anchors, edges, depth, without)) == sorted((a, len(x)) for a, x in kin.items() if x)


@pytest.mark.parametrize("name", ["cousins_d1", "cousins_d2", "cousins_without_siblings"])
def test_cousins_are_counted_without_pairs(spark, tmp_path, name):
    db = trade_folder(tmp_path, [(k, k % 2) for k in range(6)], [i % 6 for i in range(300)])
    assert moved(spark, lambda: agrees(spark, db, tmp_path, name)) < 12 * 300


def test_siblings_are_not_shuffled_as_pairs(spark, star):
    assert relations.siblings(*star).count() == 150 * 49
    assert moved(spark, lambda: relations.siblings(*star).write.format("noop").mode("overwrite").save()) < 10 * 150


def test_ancestors_are_not_shuffled_by_level(spark, tmp_path):
    db = trade_folder(tmp_path, [(k, k % 2) for k in range(6)], [i % 6 for i in range(300)])
    assert moved(spark, lambda: agrees(spark, db, tmp_path, "ancestors")) < 8 * 300


def test_fold_deals_groups_out(spark):
    """Small groups aren't put into one task for their few bytes, and a group's rows may come in several batches."""
    from pyspark.sql import functions as F

    rows = [(i, "a", f"d{i % 40}", T0 + timedelta(minutes=i), i) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, domain string, ts timestamp, seq long")
    rule = Rule("r", ("a",), Condition().has_peers("a", how_many=2), "b", "derived")
    made = derive.fold(events, [rule], key="domain")
    assert made.select(F.spark_partition_id()).distinct().count() == 4
    read = lambda: sorted((r["grp"], r["anchor_id"], r["n_contributors"], *r["contributors"]) for r in made.collect())
    whole = read()
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "7")
    try:
        assert read() == whole and len(whole) == 40 * 3
    finally:
        spark.conf.set(name, held)
    assert all(n == 3 and anchor == last for _, anchor, n, *_, last in whole)


def test_closure_of_orders_without_lines_as_in_sql(spark, tmp_path):
    db = trade_folder(tmp_path, [(0, 7), (1, 7), (2, 8), (3, 9), (4, 9)], [0, 0, 3, 4, 4])
    assert agrees(spark, db, tmp_path, "contributors_closure") == [("c:7", 4), ("c:8", None), ("c:9", 5)]
    # the operator itself leaves no order out
    from causeway.sources.model import trade_edges

    assert ids(relations.contributors_closure(as_anchors(spark, ["c:8"]), trade_edges(spark, str(tmp_path)), 2)) == ["o:2"]


def test_levels_look_again_only_at_what_is_left(spark, tmp_path):
    db = trade_folder(tmp_path, [(k, k % 2) for k in range(6)], [i % 5 for i in range(300)])
    assert moved(spark, lambda: agrees(spark, db, tmp_path, "derivation_levels_trade")) < 8 * 300


def test_levels_by_brute_force(spark):
    rng, names = random.Random(8), [f"e{i}" for i in range(16)]
    for share in (0.0, 0.1, 0.5):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < share]
        known, level = set(names) - {"e3", "e8"}, {}
        for b in names:
            level[b] = max([level[a] + 1 for a, c in pairs if c == b and a in known], default=0)
        edges, events = as_edges(spark, [*pairs, *pairs[:3]]), as_anchors(spark, [*known, "e1"]).withColumnRenamed("anchor_id", "event_id")
        assert {r["event_id"]: r["level"] for r in relations.derivation_levels(events, edges).collect()} == {x: level[x] for x in known}
        if pairs:
            with pytest.raises(ValueError, match="cycle"):
                relations.derivation_levels(events, edges.union(as_edges(spark, [("e15", "e14"), ("e14", "e15")])))


def test_signatures_by_brute_force(spark):
    from causeway.operators import memory
    from causeway.operators.fold import _fnv

    rng = random.Random(4)
    kinds = {f"e{i}": (rng.choice("ab"), rng.choice(["x", "y", None]) if i else "x") for i in range(18)}
    names = list(kinds)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[max(i + 1, 9) :] if rng.random() < 0.3]
    events = spark.createDataFrame([(n, *k) for n, k in kinds.items()], "event_id string, event_type string, domain string")
    for more in ([], [*pairs[:2], ("e0", "e17"), ("nobody", "e12")], [("e17", "e9")]):
        held = [p for p in pairs + more if kinds.get(p[0], (0, None))[1]]

        def sign(x, k):
            base = _fnv("".join(f"{part}\0" for part in kinds[x]).encode())
            return base if k == 0 else Fold._lineage(k, base, [sign(a, k - 1) for a, b in held if b == x])  # noqa: B023

        got = memory.signatures(events, as_edges(spark, pairs + more), 3)
        for k in range(4):
            assert {r["event_id"]: r["sig"] & ((1 << 64) - 1) for r in got[k].collect()} == {x: sign(x, k) for x, (_, d) in kinds.items() if d}


@pytest.mark.parametrize("name", ["sig_derived_k5", "sig_derived_deeper"])
def test_shapes_are_hashed_once_for_all_depths(spark, tmp_path, name):
    import duckdb

    from causeway import queries

    rows = [(i, "click", i % 2, T0 + timedelta(minutes=i), 1.0, '{"k": 1}') for i in range(600)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts timestamp, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rows = lambda: queries.queries()[name](spark, str(tmp_path)).collect()
    assert moved(spark, rows) < 5.4 * 600
    assert len(agrees(spark, db, tmp_path, name)) == (2 if name == "sig_derived_k5" else 6)
