"""Callers, callees, dispatch siblings, blast radius and affected tests.

Every traversal starts from a few nodes and joins outward; a level is one step of equi-joins against the edge table,
written to the shared folder so that plans stay short and lost executors are survived. Joins against a frontier are
left to adaptive execution, which broadcasts it only while it is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import edge_order
from ..sources.shared import Written
from .lookup import AFFECTED_DEPTH, IMPACT_DEPTH, MAX_AFFECTED_FILES, clamp_depth, clamp_limit, resolve_symbol

LOCATION = ("name", "kind", "file_path", "start_line")


def calls(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'calls'")


def _located(ids: DataFrame, nodes: DataFrame, limit: int | None) -> DataFrame:
    """ids (id) as sorted locations; ids without a node are skipped."""
    return ids.join(nodes, "id").select(*LOCATION).orderBy("file_path", "name", "start_line", "kind").limit(clamp_limit(limit))


def method_owners(edges: DataFrame) -> DataFrame:
    """(method, owner): of several owners the last in scan order."""
    contains = edges.filter("kind = 'contains'")
    last = F.max_by("source", F.struct(F.octet_length("source"), "source"))
    return contains.groupBy(F.col("target").alias("method")).agg(last.alias("owner"))


def implementing(edges: DataFrame) -> DataFrame:
    """type, ifaces: the interfaces that a type implements, sorted. A type names few of them."""
    pairs = edges.filter("kind = 'implements'").select(F.col("source").alias("type"), F.col("target").alias("iface"))
    return pairs.groupBy("type").agg(F.array_sort(F.collect_set("iface")).alias("ifaces"))


def dispatched(named: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Members of implementing types among named (id, name): id, name, n, mine, theirs.

    mine: (owner, ifaces) of the last owner in scan order, ifaces null where that implements nothing; n: how many implementing
    types contain the member; theirs: (owner, ifaces) of the least of them, the only one where n is 1.
    """
    contains = edges.filter("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    placed = contains.join(named.select("id", "name"), "id").join(types.withColumnRenamed("type", "owner"), "owner", "left")
    pair = F.struct("owner", "ifaces")
    per = placed.groupBy("id", "name").agg(
        F.max_by(pair, F.struct(F.octet_length("owner"), "owner")).alias("mine"),
        F.count("ifaces").alias("n"),
        F.min_by(pair, F.when(F.col("ifaces").isNotNull(), F.col("owner"))).alias("theirs"),
    )
    return per.filter("n > 0")


def _several(members: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """(sibling, name, impl, theirs) of members that several implementing types contain; few."""
    ids = members.filter("n > 1").select("id", "name")
    contains = edges.filter("kind = 'contains'").select(F.col("source").alias("impl"), F.col("target").alias("id"))
    of = types.select(F.col("type").alias("impl"), F.col("ifaces").alias("theirs"))
    return contains.join(ids, "id").join(of, "impl").select(F.col("id").alias("sibling"), "name", "impl", "theirs")


def _asked(targets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, name, owner, ifaces) of targets whose owner implements something."""
    found = members.join(targets.select("id").distinct(), "id").filter("mine.ifaces is not null")
    return found.select("id", "name", F.col("mine.owner").alias("owner"), F.col("mine.ifaces").alias("ifaces"))


def _sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (name, ifaces) and right (name, theirs) that share an interface; a pair meets at the first shared one only."""
    met = left.withColumn("iface", F.explode("ifaces")).join(right.withColumn("iface", F.explode("theirs")), ["iface", "name"])
    first = F.col("iface") == F.array_min(F.array_intersect("ifaces", "theirs"))
    return met.filter((F.size("ifaces") == 1) | (F.size("theirs") == 1) | first).drop("iface")


def dispatch_siblings(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """targets (id, name) -> (id, sibling): same-named methods of other types behind a shared interface.

    One join on (interface, name). Pairs come out once without a shuffle of pairs; only members of several types are
    made distinct.
    """
    types = implementing(edges)
    named = nodes.join(targets.select("name").distinct(), "name", "left_semi")
    members = dispatched(named, edges, types)
    asked = _asked(targets, members)
    one = members.filter("n = 1").select(F.col("id").alias("sibling"), "name", F.col("theirs.owner").alias("impl"), F.col("theirs.ifaces").alias("theirs"))
    pairs = lambda of: _sharing(asked, of).filter("impl <> owner AND sibling <> id").select("id", "sibling")
    return pairs(one).union(pairs(_several(members, edges, types)).distinct())


class Looked:
    """How many nodes of a frontier look at each node: the node itself and its siblings, counted without making the pairs.

    Frontier methods are counted by (name, interfaces of the owner) and by (name, owner). A member of a type sees the sum
    over the interface sets that meet its own, less those its own type holds. So the work of a level grows with methods and
    with distinct interface sets of a name, not with pairs of siblings. Tables that all levels share are written once.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        types = implementing(edges)
        self.members = Written(dispatched(nodes, edges, types)).df
        one = self.members.filter("n = 1")
        self.one = one.select(F.col("id").alias("tid"), "name", F.col("theirs.owner").alias("impl"), F.col("theirs.ifaces").alias("theirs"))
        shared = not self.members.filter("n > 1").isEmpty()
        self.several = Written(_several(self.members, edges, types)).df if shared else None

    def weights(self, front: DataFrame) -> DataFrame:
        """front (id) -> tid, n."""
        asked = Written(_asked(front, self.members)).df
        sets = asked.groupBy("name", "ifaces").agg(F.count(F.lit(1)).alias("c"))
        totals = _sharing(sets, self.one.select("name", "theirs").distinct()).groupBy("name", "theirs").agg(F.sum("c").alias("c"))
        own = asked.groupBy("name", F.col("owner").alias("impl")).agg(F.count(F.lit(1)).alias("o"))
        seen = self.one.join(totals, ["name", "theirs"]).join(own, ["name", "impl"], "left")
        seen = seen.select("tid", (F.col("c") - F.coalesce("o", F.lit(0))).alias("n")).filter("n > 0")
        every = front.select(F.col("id").alias("tid"), F.lit(1).cast("long").alias("n")).union(seen)
        if self.several is not None:
            many = _sharing(asked, self.several).filter("impl <> owner AND sibling <> id").select("id", "sibling").distinct()
            every = every.union(many.select(F.col("sibling").alias("tid"), F.lit(1).cast("long").alias("n")))
        return every.groupBy("tid").agg(F.sum("n").alias("n"))


def callees(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    start = resolve_symbol(nodes, symbol).select(F.col("id").alias("source"))
    found = calls(edges).join(start, "source").select(F.col("target").alias("id")).distinct()
    return _located(found, nodes, limit)


def callers(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    """Callers of the node and of its dispatch siblings, once each."""
    start = resolve_symbol(nodes, symbol).select("id", "name")
    targets = start.select("id").union(dispatch_siblings(start, nodes, edges).select("sibling")).distinct()
    found = calls(edges).join(targets.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id")).distinct()
    return _located(found, nodes, limit)


def walk_callers(
    nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int, leaf: Callable | None = None
) -> tuple[DataFrame, int, int]:
    """Breadth-first over reverse calls with siblings at every node.

    start: (id, name). Returns (id, level, leaf) of every node reached but the start, the count of call edges looked at
    (each frontier node looks at its own and its siblings' edges, visited or not) and the number of levels walked.
    ``leaf``: a condition on file_path; nodes that meet it are reported but not expanded.
    """
    back = calls(edges).select(F.col("source").alias("caller"), F.col("target").alias("tid"))
    looker = Looked(nodes, edges)
    front = Written(start.select("id", "name")).df
    visited = front.select("id")
    reached: DataFrame | None = None
    counts: DataFrame | None = None
    level = 0
    while level < depth:
        level += 1
        looked = looker.weights(front).join(back, "tid").groupBy("caller").agg(F.sum("n").alias("n"))
        looked = Written(looked).df
        counts = looked.select("n") if counts is None else counts.union(looked.select("n"))
        fresh = looked.select(F.col("caller").alias("id")).join(visited, "id", "left_anti")
        here = fresh.join(nodes.select("id", "name", "file_path"), "id")
        here = Written(here.withColumn("leaf", leaf(F.col("file_path")) if leaf else F.lit(False))).df
        found = here.select("id", F.lit(level).alias("level"), "leaf")
        reached = found if reached is None else reached.union(found)
        front = here.filter("not leaf").select("id", "name")
        if front.isEmpty():
            break
        visited = start.select("id").union(reached.select("id"))
        if level % 16 == 0:  # short plans on long chains
            reached, counts = Written(reached).df, Written(counts.agg(F.sum("n").alias("n"))).df
    if reached is None:
        reached = start.select("id", F.lit(0).alias("level"), F.lit(False).alias("leaf")).limit(0)
    inspected = counts.agg(F.sum("n")).first()[0] if counts is not None else 0
    return reached, inspected or 0, level


def impact(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int | None = None) -> DataFrame:
    """Locations of the node and everything that reaches it by calls, with node_count and edge_count on every row."""
    start = resolve_symbol(nodes, symbol).select("id", "name")
    reached, inspected, _ = walk_callers(nodes, edges, start, clamp_depth(depth, IMPACT_DEPTH))
    everything = Written(start.select("id").union(reached.select("id")).join(nodes, "id").select(*LOCATION)).df
    return everything.withColumns(
        {"node_count": F.lit(everything.count()).cast("long"), "edge_count": F.lit(inspected).cast("long")}
    ).orderBy("file_path", "name", "start_line", "kind")


def affected(nodes: DataFrame, edges: DataFrame, files: list[str], depth: int | None = None) -> DataFrame:
    """Test symbols that depend on nodes of the files; a test is a leaf of the walk."""
    if len(files) > MAX_AFFECTED_FILES:
        raise ValueError(f"more than {MAX_AFFECTED_FILES} files")
    names = nodes.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(files)], "file_path string")
    start = nodes.join(names, "file_path", "left_semi").select("id", "name")
    reached, _, _ = walk_callers(nodes, edges, start, clamp_depth(depth, AFFECTED_DEPTH), leaf=paths.is_test_symbol)
    tests = reached.filter("leaf").select("id")
    return tests.join(nodes, "id").select(*LOCATION).orderBy("file_path", "name", "start_line", "kind")


def affected_paths(tests: DataFrame, pattern: str = "") -> DataFrame:
    """Distinct test files, one a row, by a glob on the whole path; names with a line feed are skipped."""
    if pattern:
        tests = tests.filter(F.col("file_path").rlike(paths.glob_regex(pattern)))
    return tests.select("file_path").filter(~F.contains("file_path", F.lit("\n"))).distinct().orderBy("file_path")


def call_trail(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """One row: names of direct callees and callers of the node, in scan order, siblings and repeats included."""
    start = resolve_symbol(nodes, symbol).select("id")
    named = nodes.select("id", "name")
    out = calls(edges).join(start, F.col("source") == F.col("id")).select(F.lit("callees").alias("side"), F.col("target").alias("id"))
    into = calls(edges).join(start, F.col("target") == F.col("id")).select(F.lit("callers"), F.col("source"))
    both = out.union(into).join(named, "id").withColumn("key", F.struct(F.octet_length("id"), "id", "name"))
    lists = both.groupBy("side").agg(F.transform(F.sort_array(F.collect_list("key")), lambda k: k["name"]).alias("names"))
    return lists.select("side", F.array_join("names", ", ").alias("names"), F.size("names").cast("long").alias("n"))


def affected_edges_order(edges: DataFrame) -> DataFrame:
    """Edges in scan order."""
    return edges.orderBy(*edge_order("source", "kind", "target"))


def blast_radius(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ids (id) -> id, callers (all reverse calls), test_files (of callers that have a node), sorted."""
    back = calls(edges).select(F.col("target").alias("id"), F.col("source").alias("caller"))
    paths_of = nodes.select(F.col("id").alias("caller"), F.col("file_path").alias("path"))
    met = ids.select("id").join(back, "id", "left").join(paths_of, "caller", "left")
    return met.groupBy("id").agg(
        F.count("caller").alias("callers"),
        F.sort_array(F.collect_set(F.when(paths.is_test_symbol(F.col("path")), F.col("path")))).alias("test_files"),
    )
