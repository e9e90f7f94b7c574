"""What must not grow faster than the input: tasks that take one key, rows that are dealt, tables that are written."""

import random

from pyspark.sql import functions as F

from graphloom.operators import gather, resolve, scoring, sync, synthesis
from graphloom.plans import catalog
from graphloom.sources import projection, shared
from graphloom.streaming import watch
from tests import graphs
from tests.conftest import SF
from tests.plans import dealt, ran


def named(operators) -> set[str]:
    return {x.getClass().getSimpleName() for x in operators}


def same(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_the_projection_is_that_of_the_sql_and_deals_by_its_rows(spark):
    for name in ("nodes", "edges"):
        want = projection._select(spark, SF, name)
        assert same(getattr(projection, name)(spark, SF).select(*want.columns), want)
    assert shared.tasks_of(spark.range(1000), rows=10) == 100 and shared.tasks_of(spark.range(0)) == 1


def test_bursts_of_a_table_are_session_windows_without_a_task_a_key(spark):
    rnd = random.Random(1)
    rows = [("k", t) for t in (0, 2_000_000, 3_999_999, 5_999_998)] + [("j", 0), ("j", 2_000_001)]
    rows += [(rnd.choice(["a", None, "b"]), rnd.randrange(-9_000_000_000, 9_000_000_000)) for _ in range(3000)]
    rows += [("c", k * 1_000_000 + rnd.randrange(5)) for k in range(5000)]  # one burst over several blocks
    made = [(k, str(t % 7) if t % 5 else None, t) for k, t in rows]
    df = spark.createDataFrame(made, "key string, path string, us long").select("key", "path", F.timestamp_micros("us").alias("ts"))
    window = F.session_window("ts", "2 seconds").alias("b")
    want = df.groupBy("key", window).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events"))
    got = watch.debounce(df, "2 seconds", ["key"])
    assert same(got, want.select("key", F.col("b.start").alias("started"), F.col("b.end").alias("ended"), "paths", "n_events"))
    assert not {x for x in named(ran(got)[1]) if "Session" in x}


def test_structs_and_interfaces_meet_without_dealing_their_pairs(spark):
    structs, ifaces = [f"S{k}" for k in range(60)], [f"I{k}" for k in range(40)]
    n = graphs.nodes(
        spark, *[(s, "struct", s, "f") for s in structs], *[(i, "interface", i, "f") for i in ifaces],
        *[(f"{s}.{m}", "method", m, "f") for s in structs for m in "ab"],
    )
    e = graphs.edges(spark, *[(s, "contains", f"{s}.{m}") for s in structs for m in "ab"])
    spec = spark.createDataFrame([(i, m, 0) for i in ifaces for m in "ab"], "iface_id string, name string, arity int")
    arity = spark.createDataFrame([(f"{s}.{m}", 0) for s in structs for m in "ab"], "method_id string, arity int")
    rows, operators = ran(synthesis.structural_implements(e, n, spec, arity))
    assert {(r["source"], r["target"]) for r in rows} == {(s, i) for s in structs for i in ifaces} and len(rows) == 2400
    assert dealt(operators) < 300


def test_mass_is_a_partial_aggregate_and_repeats_in_any_order(spark):
    rows = [(f"n{k}", k % 97 * 1e-9 + k) for k in range(300)]
    n = graphs.nodes(spark, *[(x, "function", x, "a.go") for x, _ in rows])
    found = []
    for order in (rows, rows[::-1]):
        mass = scoring.file_mass(n, spark.createDataFrame(order, "id string, score double").repartition(3))
        got, operators = ran(mass)
        assert "ObjectHashAggregateExec" not in named(operators)
        found.append(got[0]["mass"])
    assert found[0] == found[1] == (sum(k % 97 + k * 10**9 for k in range(300))) / 1e9


def test_files_are_counted_without_sorting_nodes(spark):
    assert not named(ran(catalog._files(spark, SF))[1]) & {"SortAggregateExec", "SortExec"}


def test_calls_climb_only_until_they_are_matched(spark, monkeypatch):
    """A chain of forty types that all have the name: pairs of types and all their supertypes are not made. Cycles end."""
    types = [f"T{k:02}" for k in range(40)]
    n = graphs.nodes(spark, *[(t, "struct", t, "f") for t in types], *[(f"{t}.m", "method", "m", "f") for t in types])
    up = [(a, "extends", b) for a, b in zip(types, types[1:])]
    e = graphs.edges(spark, *up, *[(t, "contains", f"{t}.m") for t in types])
    made, first = [], synthesis.Written

    def counted(df):
        found = first(df)
        made.append(found.df.count())
        return found

    monkeypatch.setattr(synthesis, "Written", counted)
    pending = spark.createDataFrame([(f"{t}.m", "m", None) for t in types], "from_id string, name string, target string")
    got = {r["from_id"]: r["target"] for r in synthesis.retry_calls(pending, e, n).collect()}
    assert got == {f"{a}.m": f"{b}.m" for a, b in zip(types, types[1:])} | {"T39.m": None} and sum(made) < 300
    monkeypatch.setattr(synthesis, "Written", first)
    e = graphs.edges(spark, ("A", "extends", "B"), ("B", "extends", "C"), ("C", "extends", "D"), ("D", "extends", "B"), ("A", "contains", "A.m"))
    pending = spark.createDataFrame([("A.m", "x", None)], "from_id string, name string, target string")
    assert [r["target"] for r in synthesis.retry_calls(pending, e, n).collect()] == [None]


def test_only_references_that_ask_for_kinds_are_dealt_to_them(spark):
    names = "from_id string, name string, pkg_alias string, kind string, target string, line int, col int, file string"
    rows = [(f"m{k}", "f", "", "calls", "t", 1, 0, "a.go") for k in range(300)] + [("m0", "f", "", "embeds", "t", 1, 0, "a.go"), ("m1", "f", "", "instantiates", "t", 1, 0, "a.go")]
    kinds = spark.createDataFrame([("t", "struct"), ("m0", "struct")], "id string, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, operators = ran(resolve.reference_edges(spark.createDataFrame(rows, names), kinds, "m"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted({(r["kind"], r["state"]) for r in got}) == [("calls", "edge"), ("extends", "edge"), ("instantiates", "edge")] and len(got) == 302
    assert dealt(operators) < 20


def test_edges_are_dealt_once_when_files_go(spark):
    n = graphs.nodes(spark, *[(f"n{k}", "function", "f", "a.go" if k else "gone.go") for k in range(200)])
    e = graphs.edges(spark, *[(f"n{k}", "calls", "n0", k) for k in range(200)], ("nobody", "calls", "n0"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, operators = ran(sync.prune_edges(e, n, spark.createDataFrame([("gone.go",)], "path string")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["source"] for r in got} == {f"n{k}" for k in range(1, 200)} | {"nobody"} and len(got) == 200
    assert dealt(operators) < 500


def test_exact_names_of_a_file_are_counted_without_a_window(spark):
    n = graphs.nodes(spark, ("1", "function", "a", "x.go"), ("2", "function", "a", "x.go"), ("3", "function", "b", "x.go"), ("4", "function", "a", "y.go"))
    got, operators = ran(gather.by_exact_name(n, ["a", "b"]))
    assert {r["id"]: r["score"] for r in got} == {"1": 30.0, "2": 30.0, "3": 30.0, "4": 10.0} and "WindowExec" not in named(operators)
