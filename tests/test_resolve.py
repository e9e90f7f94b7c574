from graphloom import schema
from graphloom.functions import hashing
from graphloom.ingest.rows import node_id
from graphloom.operators import expand, resolve, synthesis
from tests import graphs

from pyspark.sql import functions as F


def refs(spark, *rows):
    """(from_id, kind, name, alias)"""
    made = [("f.go", "m", r[0], r[2], r[3] if len(r) > 3 else "", r[1], 4, 2) for r in rows]
    names = "file string, module_key string, from_id string, name string, pkg_alias string, kind string, line int, col int"
    return schema.conform(spark.createDataFrame(made, names), schema.REFS)


def outcome(spark, *rows, imports=()):
    n = graphs.nodes(
        spark, ("fn1", "function", "Do", "f.go"), ("fn0", "function", "Do", "f.go"), ("st", "struct", "Thing", "f.go"), ("if", "interface", "Doer", "f.go"),
        ("other", "function", "Far", "g.go"), ("me", "function", "Me", "f.go"),
    )
    modules = spark.createDataFrame([("f.go", "m"), ("g.go", "far/mod")], "file_path string, module_key string")
    use = spark.createDataFrame([("f.go", a, m) for a, m in imports], "file string, alias string, target_module string")
    found = resolve.resolve_names(refs(spark, *rows), use, resolve.symbol_index(n, modules))
    return [(r["source"], r["kind"], r["target"], r["state"]) for r in resolve.reference_edges(found, n.select("id", "kind"), "mod").collect()]


def test_names_resolve_to_the_lowest_id(spark):
    assert outcome(spark, ("me", "calls", "Do")) == [("me", "calls", "fn0", "edge")]


def test_aliases_need_an_import(spark):
    assert outcome(spark, ("me", "calls", "Far", "far"), imports=[("far", "far/mod")]) == [("me", "calls", "other", "edge")]
    assert outcome(spark, ("me", "calls", "Far", "far"))[0][3] == "pending"
    assert outcome(spark, ("me", "references", "Far", "<local:x>"))[0][3] == "unresolved"


def test_embeds_split_by_kinds(spark):
    assert outcome(spark, ("st", "embeds", "Doer"))[0][1] == "implements"
    assert outcome(spark, ("st", "embeds", "Thing"))[0][1] == "extends"
    assert outcome(spark, ("if", "embeds", "Doer"))[0][1] == "embeds"


def test_contains_is_turned_and_instantiates_needs_a_struct(spark):
    assert outcome(spark, ("me", "contains", "Thing")) == [("st", "contains", "me", "edge")]
    assert outcome(spark, ("me", "instantiates", "Thing"))[0][3] == "edge"
    assert outcome(spark, ("me", "instantiates", "Do"))[0][3] == "unresolved"


def test_imports_inside_the_module_only(spark):
    inside, = outcome(spark, ("me", "imports", "mod/x"))
    assert inside[3] == "edge" and inside[2] == node_id("package", "mod/x", "mod/x")
    assert outcome(spark, ("me", "imports", "modern"))[0][3] == "external"


def test_node_ids_agree_for_long_names(spark):
    rows = [("function", "é" * n, "p/" * n) for n in (1, 63, 64, 100, 9000)]
    df = spark.createDataFrame(rows, "k string, q string, p string")
    got = df.select("*", hashing.node_id(F.col("k"), F.col("q"), F.col("p")).alias("id")).collect()
    assert all(r["id"] == node_id(r["k"], r["q"], r["p"]) for r in got)


def test_collapse_in_any_order(spark):
    n = graphs.nodes(spark, ("a", "function", "a", "a.go"), ("b", "function", "b", "b.go"))
    rows = [("a", "calls", "b", k) for k in (9, 3, 7)]
    for order in (rows, rows[::-1]):
        once = resolve.collapse(graphs.edges(spark, *order), n)
        assert [(r["source"], r["line"]) for r in once.collect()] == [("a", 3)]
        assert resolve.collapse(once, n).collect() == once.collect()


def arities(spark, *rows):
    return spark.createDataFrame(list(rows), "method_id string, arity int")


def specs(spark, *rows):
    return spark.createDataFrame(list(rows), "iface_id string, name string, arity int")


def test_structural_implements(spark):
    n = graphs.nodes(
        spark, ("S", "struct", "S", "s"), ("I", "interface", "I", "i"), ("J", "interface", "J", "j"), ("E", "interface", "E", "e"),
        ("S.a", "method", "a", "s"), ("S.b", "method", "b", "s"),
    )
    e = graphs.edges(spark, ("S", "contains", "S.a"), ("S", "contains", "S.b"), ("J", "embeds", "I"))
    have = arities(spark, ("S.a", 1), ("S.b", 2))
    found = lambda *s: sorted(r["target"] for r in synthesis.structural_implements(e, n, specs(spark, *s), have).collect())
    assert found(("I", "a", 1)) == ["I"]
    assert found(("I", "a", 2)) == [] and found(("I", "a", 1), ("I", "c", 0)) == []
    assert found(("I", "a", 1), ("J", "b", 2)) == ["I", "J"]
    assert found(("I", "c", 0), ("J", "b", 2)) == []


def test_overrides(spark):
    n = graphs.nodes(spark, *[(x, "struct", x, "f") for x in "ABC"], *[(m, "method", "m", "f") for m in ("A.m", "B.m", "C.m", "C.n")])
    e = graphs.edges(
        spark, ("A", "contains", "A.m"), ("B", "contains", "B.m"), ("C", "contains", "C.m"), ("C", "contains", "C.n"), ("A", "extends", "B"), ("B", "extends", "C")
    )
    got = lambda *a: {(r["source"], r["target"]) for r in synthesis.overrides(e, n, arities(spark, *a)).collect()}
    assert got(("A.m", 1), ("B.m", 1), ("C.m", 1), ("C.n", 2)) == {("A.m", "B.m"), ("B.m", "C.m")}
    assert got(("A.m", 1), ("B.m", 2), ("C.m", 1), ("C.n", 2)) == {("A.m", "C.m"), ("B.m", "C.n")}
    assert got(("A.m", 1), ("B.m", 7), ("C.m", 5), ("C.n", 6)) == set()


def test_deep_hierarchies(spark):
    """Seventy types above one another: no level is left out."""
    n = graphs.nodes(spark, *[(f"T{k:02}", "struct", f"T{k:02}", "a.go") for k in range(72)], ("T00.m", "method", "m", "a.go"), ("T71.m", "method", "m", "a.go"))
    e = graphs.edges(spark, *[(f"T{k:02}", "extends", f"T{k + 1:02}") for k in range(71)], ("T00", "contains", "T00.m"), ("T71", "contains", "T71.m"))
    arity = spark.createDataFrame([("T00.m", 1), ("T71.m", 1)], "method_id string, arity int")
    assert [(r["source"], r["target"]) for r in synthesis.overrides(e, n, arity).collect()] == [("T00.m", "T71.m")]
    up = e.filter("kind = 'extends'").selectExpr("source AS a", "target AS b")
    found = expand.closure(spark.createDataFrame([("T00",)], "root string"), up)
    assert found.count() == 71 and found.agg({"depth": "max"}).first()[0] == 71
