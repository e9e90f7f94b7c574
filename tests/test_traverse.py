import random
from collections import Counter

import pytest

from graphloom.operators import expand, lookup, rank, traverse
from graphloom.plans import catalog
from graphloom.plans.catalog import QUERIES
from tests import graphs
from tests.conftest import SF


def names(df):
    return sorted(r["name"] for r in df.collect())


@pytest.mark.parametrize("depth, n, e", [(1, 2, 1), (2, 3, 2), (999_999, 4, 3)])
def test_impact_of_a_chain(spark, depth, n, e):
    found = traverse.impact(*graphs.chain(spark), "helper", depth).collect()
    assert len(found) == n and {(r["node_count"], r["edge_count"]) for r in found} == {(n, e)}


def test_default_depth_is_two(spark):
    assert traverse.impact(*graphs.chain(spark), "helper").count() == 3


def test_callers_include_dispatch_siblings(spark):
    n, e = graphs.dispatch(spark)
    assert names(traverse.callers(n, e, "m")) == ["ca", "cb"]
    pairs = traverse.dispatch_siblings(n.filter("id = 'A.m'"), n, e).collect()
    assert [(r["id"], r["sibling"]) for r in pairs] == [("A.m", "B.m")]


@pytest.mark.parametrize("seed", range(3))
def test_siblings_and_their_weights_against_brute_force(spark, seed):
    """Types of several interfaces, members of several types, owners that implement nothing."""
    rnd = random.Random(seed)
    types, ifaces = [f"T{k}" for k in range(7)], ["I1", "I2", "I3"]
    implements = {(t, i) for t in types[:6] for i in ifaces if rnd.random() < 0.5}
    name = {f"m{k}": rnd.choice("xy") for k in range(14)}
    contains = {(rnd.choice(types), m) for m in name} | {(rnd.choice(types), rnd.choice(list(name))) for _ in range(4)}
    n = graphs.nodes(spark, *[(m, "method", x, "a.go") for m, x in name.items()])
    e = graphs.edges(spark, *[(t, "implements", i) for t, i in implements], *[(t, "contains", m) for t, m in contains])
    owner = {m: max((len(t), t) for t, x in contains if x == m)[1] for m in name}
    of = lambda t: {i for x, i in implements if x == t}
    want = {
        (a, b) for a in name for t, b in contains
        if a != b and name[a] == name[b] and t != owner[a] and of(t) & of(owner[a])
    }
    found = [(r["id"], r["sibling"]) for r in traverse.dispatch_siblings(n, n, e).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    front = n.filter("id < 'm5'")
    started = {r["id"] for r in front.select("id").collect()}
    weights = {r["tid"]: r["n"] for r in traverse.Looked(n, e).weights(front).collect()}
    assert weights == Counter(list(started) + [b for a, b in want if a in started])


def test_dangling_edges_are_skipped(spark):
    n, e = graphs.chain(spark)
    e = e.union(graphs.edges(spark, ("gone", "calls", "helper"), ("helper", "calls", "lost")))
    assert names(traverse.callers(n, e, "helper")) == ["Alpha"]
    assert names(traverse.callees(n, e, "helper")) == []
    assert traverse.impact(n, e, "helper", 1).first()["edge_count"] == 2


def test_unknown_symbol_is_empty(spark):
    n, e = graphs.chain(spark)
    assert traverse.callers(n, e, "nobody").count() == 0
    assert traverse.impact(n, e, "nobody").count() == 0


def test_affected_stops_at_tests(spark):
    n = graphs.nodes(
        spark, ("p", "function", "p", "p.go"), ("q", "function", "q", "q.go"), ("t", "function", "T", "q_test.go"), ("u", "function", "U", "u_test.go")
    )
    e = graphs.edges(spark, ("q", "calls", "p"), ("t", "calls", "q"), ("u", "calls", "t"))
    assert names(traverse.affected(n, e, ["p.go"])) == ["T"]
    with pytest.raises(ValueError):
        traverse.affected(n, e, [str(k) for k in range(10_001)])
    paths = traverse.affected_paths(traverse.affected(n, e, ["p.go"]), "*_test.go").collect()
    assert [r[0] for r in paths] == ["q_test.go"]


def test_cycles_end(spark):
    n = graphs.nodes(spark, ("a", "function", "a", "a.go"), ("b", "function", "b", "b.go"))
    e = graphs.edges(spark, ("a", "calls", "b"), ("b", "calls", "a"))
    assert names(traverse.impact(n, e, "a", 50)) == ["a", "b"]


def test_lexical_tiers_and_limits(spark):
    n = graphs.nodes(spark, ("1", "function", "Foo", "a"), ("2", "function", "FooBar", "a"), ("3", "method", "aFoo", "a"), ("4", "method", "foo", "a"))
    assert [(r["id"], r["tier"]) for r in lookup.query(n, "Foo").collect()] == [("1", 0), ("2", 1), ("3", 2)]
    assert [r["name"] for r in lookup.search(n, "Foo", "method").collect()] == ["aFoo"]
    for bad in (lambda: lookup.query(n, " "), lambda: lookup.query(n, "x", "route"), lambda: lookup.query(n, "x", "", -1)):
        with pytest.raises(ValueError):
            bad()


def test_narrowing_never_empties(spark):
    n = graphs.nodes(spark, ("1", "function", "f", "a/x.go", 1, 9), ("2", "function", "f", "b/y.pb.go", 5, 20), ("3", "function", "f", "b/z.go", 30, 40))
    defs = lookup.definitions(n, "f")
    assert [r["id"] for r in defs.orderBy("pos").collect()] == ["1", "3", "2"]
    ids = lambda **h: [r["id"] for r in lookup.narrow(defs, **h).collect()]
    assert ids(file_hint="B\\Z.go") == ["3"] and ids(file_hint="nowhere") == ["1", "3", "2"]
    assert ids(line_hint=7) == ["1", "2"] and ids(line_hint=27) == ["3"]


def test_affected_to_its_own_depth(spark):
    shallow, whole = (QUERIES[x](spark, SF).count() for x in ("affected", "affected_whole"))
    assert (shallow, whole) == (183, 214)


def test_walk_over_the_whole_graph(spark):
    nodes, edges = catalog.graph(spark, SF)
    links = [(r["source"], r["target"]) for r in expand.rank_edges(edges).collect()]
    want = rank.walk(sorted({r["id"] for r in nodes.select("id").collect()}), links, {"function:3", "struct:7"})
    got = {r["id"]: r["score"] for r in QUERIES["random_walk_whole"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 2e-7 for k in want)
    assert any(v > 0 for k, v in got.items() if k.startswith("method:"))
