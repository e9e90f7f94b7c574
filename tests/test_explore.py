import random

import pytest

from graphloom.functions import paths, text
from graphloom.operators import expand, explore, gather, rank, scoring, seeding
from tests import graphs

from pyspark.sql import functions as F


def test_tokens():
    assert set(text.search_terms("getUserName by id")) >= {"getusername", "get", "user", "name"}
    assert not {"by", "id"} & set(text.search_terms("getUserName by id"))
    assert text.search_terms("the fix bug") == []
    assert text.symbol_tokens("config.database.host") == ["config.database.host", "config", "database", "host"]
    assert text.symbol_tokens("REST HTTP api") == ["REST", "HTTP", "api"]
    assert text.symbol_tokens("  ") == [] == text.search_terms("")


def test_token_columns_agree_with_the_driver(spark):
    queries = ["getUserName by id", "snake_case_name and HTTPServer", "a.b.c MAX_SIZE foo", "", "étéFoo fooé"]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    got = df.select("q", text.symbol_tokens_column(F.col("q")).alias("s"), text.search_terms_column(F.col("q")).alias("t")).collect()
    for r in got:
        assert r["s"] == text.symbol_tokens(r["q"]) and r["t"] == text.search_terms(r["q"])


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.go", "a.go", True), ("*.go", "a/b.go", False), ("a/?.go", "a/b.go", True), ("[a-c].go", "b.go", True), ("[^a].go", "a.go", False), (r"\*.go", "*.go", True)],
)
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").filter(F.col("p").rlike(paths.glob_regex(glob))).count() == hit


@pytest.mark.parametrize("bad", ["[a", "a\\"])
def test_malformed_globs(bad):
    with pytest.raises(ValueError):
        paths.glob_regex(bad)


STAR = [("a", "b"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "z")]


def test_random_walk_on_a_star():
    ids = sorted({"iso", *[x for e in STAR for x in e]})
    s = rank.walk(ids, STAR, {"a"})
    assert s["a"] > s["z"] and s["iso"] == 0
    assert rank.walk(ids, STAR, {"iso"})["iso"] == 1
    assert all(v > 0 for v in rank.walk(ids, STAR, set()).values())
    assert rank.walk([], [], set()) == {}


def test_distributed_walk_agrees(spark):
    n = graphs.nodes(spark, *[(x, "function", x, "f") for x in sorted({"iso", *[x for e in STAR for x in e]})])
    e = graphs.edges(spark, *[(a, "calls", b) for a, b in STAR], ("a", "references", "b"))
    want = rank.walk(sorted(r["id"] for r in n.collect()), [*STAR, ("a", "b")], {"a", "iso"})
    got = rank.walk_distributed(n, e, n.filter("id IN ('a', 'iso')")).collect()
    assert {r["id"]: r["score"] for r in got} == pytest.approx(want, abs=2e-9)


def test_exact_names_lift_each_other(spark):
    n = graphs.nodes(spark, ("1", "function", "foo", "a"), ("2", "function", "bar", "a"), ("3", "function", "foo", "b"))
    got = {r["id"]: r["score"] for r in gather.by_exact_name(n, ["foo", "bar"]).collect()}
    assert got == {"1": 30.0, "2": 30.0, "3": 10.0}


def test_prefix_and_text_scores(spark):
    n = graphs.nodes(spark, ("1", "struct", "Order", "a"), ("2", "struct", "OrderBook", "a"), ("3", "function", "OrderX", "a"))
    got = {r["id"]: round(r["score"], 6) for r in gather.by_title_prefix(n, ["order"]).collect()}
    assert got == {"1": 25.0, "2": round(15 + 10 - 4 / 3, 6)}
    assert {r["id"]: r["score"] for r in gather.by_text(n, ["order", "book"]).collect()} == {"1": 10.0, "2": 15.0, "3": 10.0}
    assert gather.by_exact_name(n, []).count() == 0 == gather.by_text(n, []).count()


def test_dampening_spares_distinctive_names(spark):
    n = graphs.nodes(spark, ("1", "function", "parse_thing", "x_test.go"), ("2", "function", "parse", "y_test.go"), ("3", "function", "q", "z/z.go"))
    rows = gather._scored(n, F.lit(100.0), "text").withColumn("channels", F.array("channel"))
    got = {r["id"]: r["score"] for r in gather.rerank(rows, "parse_thing", ["parse_thing"]).collect()}
    assert got["1"] == 100.0 and got["2"] == 30.0
    assert all(r["score"] >= 100 for r in gather.rerank(rows, "test parse", []).collect())


def hierarchy(spark):
    n = graphs.nodes(spark, *[(x, "struct", x, "f") for x in ("base", "mid", "leaf", "sib", "far")])
    return n, graphs.edges(spark, ("mid", "extends", "base"), ("leaf", "extends", "mid"), ("sib", "extends", "mid"), ("base", "extends", "mid"))


def test_type_hierarchy(spark):
    n, e = hierarchy(spark)
    focal = n.filter("id = 'leaf'")
    assert expand.type_hierarchy(n, e, focal) == ["base", "mid", "sib"]
    assert expand.type_hierarchy(n, e, focal, 4) == ["mid"]
    assert expand.type_hierarchy(n, e, focal, 0) == [] and expand.hierarchy_budget(200) == 50


def test_bounded_bfs_is_capped_and_ordered(spark):
    n = graphs.nodes(spark, *[(f"n{k}", "function", f"n{k}", "f") for k in range(30)])
    e = graphs.edges(spark, *[("n0", "calls", f"n{k}") for k in range(1, 30)], ("n0", "calls", "absent"))
    roots = n.filter("id = 'n0'").withColumn("score", F.lit(1.0))
    reached, seeds = expand.bounded_bfs(n, e, roots, max_nodes=5)
    assert seeds == ["n0"] and reached == sorted(["n0", "n1", "n10", "n11", "n12"])
    assert expand.bounded_bfs(n, e, roots.withColumn("score", F.lit(0.1))) == ([], [])


def test_seeds_of_overloads(spark):
    n = graphs.nodes(
        spark, ("a1", "function", "few", "f"), ("a2", "function", "few", "g"), *[(f"m{k}", "method", "many", "f", 1, 1 + k) for k in range(4)],
        ("T", "struct", "Thing", "f"), ("c1", "function", "c1", "f"), ("c2", "function", "c2", "f"),
    )
    e = graphs.edges(spark, ("c1", "calls", "a2"), ("c2", "calls", "a2"), ("T", "contains", "m1"))
    got = {(r["id"], r["is_primary"]) for r in seeding.named_seeds(n, e, "few many").collect()}
    assert got == {("a1", True), ("a2", True), ("m3", True)}
    assert {r["id"] for r in seeding.named_seeds(n, e, "many Thing").collect()} == {"m1", "T"}


def profile(**k):
    base = dict(file_path="f", score=1.0, mass=0.0, hits=0, n_nodes=1, central=False, rescued=False, low_value=False, generated=False)
    return base | k


@pytest.mark.parametrize("clause", [dict(mass=0.9), dict(central=True), dict(score=10.0), dict(rescued=True), dict(hits=2)])
def test_each_gate_clause_keeps_a_file(spark, clause):
    rows = [profile(file_path="top", mass=1.0), profile(file_path="out", mass=0.01), profile(file_path="it", **({"mass": 0.01} | clause))]
    kept = {r["file_path"] for r in scoring.gate(spark.createDataFrame(rows)).collect()}
    assert kept == {"top", "it"}


def test_gate_never_goes_below_two(spark):
    rows = [profile(file_path="top", mass=1.0), profile(file_path="out", mass=0.01)]
    assert scoring.gate(spark.createDataFrame(rows)).count() == 2


def test_file_order_does_not_depend_on_block_borders():
    rng = random.Random(3)
    rows = [profile(file_path=f"{k:03}", mass=float(k), hits=rng.randrange(3)) for k in range(70)]
    assert [r["file_path"] for r in scoring.order_files(rows)] == [f"{k:03}" for k in reversed(range(70))]
    tied = [profile(file_path=f"{k:03}", mass=1.0, hits=k % 2) for k in range(6)]
    assert [r["file_path"] for r in scoring.order_files(tied)] == ["001", "003", "005", "000", "002", "004"]
    assert scoring.order_files([]) == [] and [scoring.file_budget(n) for n in (20, 21, 500, 501)] == [3, 5, 8, 12]


def test_explore_end_to_end(spark):
    n = graphs.nodes(
        spark, ("s", "struct", "Ledger", "ledger/ledger.go", 1, 30), ("m", "method", "Post", "ledger/ledger.go", 5, 9),
        ("c", "function", "CloseDay", "orders/close.go", 1, 9), ("t", "function", "TestClose", "orders/close_test.go", 1, 9),
        ("z", "function", "unrelated", "misc/z.go", 1, 2),
    )
    e = graphs.edges(spark, ("s", "contains", "m"), ("c", "calls", "m"), ("t", "calls", "c"), ("c", "instantiates", "s"))
    found = explore.explore(n, e, "Ledger Post")
    assert [f["file_path"] for f in found.files][0] == "ledger/ledger.go" and "misc/z.go" not in [f["file_path"] for f in found.files]
    rows = {r["id"]: r for r in found.symbols.collect()}
    assert rows["m"]["callers"] == 1 and "t" not in rows
    assert explore.explore(n, e, "zzzz").symbols is None
    with pytest.raises(ValueError):
        explore.explore(n, e, " ")
