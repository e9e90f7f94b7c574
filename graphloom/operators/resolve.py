"""From references to edges: the symbol index, qualified and unqualified joins, one edge rule a reference kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from ..functions.hashing import node_id
from ..sources.shared import written
from . import synthesis


def symbol_index(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """module_key, name -> target (lowest id), collisions. modules: (file_path, module_key) of files without errors."""
    named = nodes.filter("kind <> 'file'").join(modules, "file_path")
    return named.groupBy("module_key", "name").agg(F.min("id").alias("target"), (F.countDistinct("id") - 1).alias("collisions"))


def lookups(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """file, module_key, name: where references are looked up; those of aliases that are not imported are looked up nowhere."""
    imported = imports.select("file", F.col("alias").alias("pkg_alias"), "target_module")
    module = F.when(F.col("pkg_alias") == "", F.col("module_key")).otherwise(F.col("target_module"))
    asked = refs.select("file", "pkg_alias", "module_key", "name").join(imported, ["file", "pkg_alias"], "left")
    return asked.select("file", module.alias("module_key"), "name").filter("module_key is not null").distinct()


def resolve_names(refs: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """refs with ``target`` (null: unresolved). Without an alias the own module is searched, else the imported one."""
    imported = imports.select("file", F.col("alias").alias("pkg_alias"), "target_module")
    where = refs.join(imported, ["file", "pkg_alias"], "left")
    module = F.when(F.col("pkg_alias") == "", F.col("module_key")).otherwise(F.col("target_module"))
    names = index.select(F.col("module_key").alias("_module"), F.col("name").alias("_name"), "target")
    asked = where.withColumn("_in", module)
    return asked.join(names, (asked["_in"] == names["_module"]) & (asked["name"] == names["_name"]), "left").drop(
        "_in", "_module", "_name", "target_module"
    )


def package_nodes(refs: DataFrame, module_path: str) -> DataFrame:
    """Nodes of packages inside the module that are imported."""
    inside = refs.filter((F.col("kind") == "imports") & paths.under(F.col("name"), module_path)).select("name").distinct()
    rows = inside.select(
        node_id(F.lit("package"), F.col("name"), F.col("name")).alias("id"),
        F.lit("package").alias("kind"),
        paths.last_segment(F.col("name")).alias("name"),
        F.col("name").alias("qualified_name"),
    )
    return schema.conform(rows, schema.NODES)


def reference_edges(resolved: DataFrame, kinds: DataFrame, module_path: str) -> DataFrame:
    """Edges and leftovers of resolved references: source, target, kind, line, col, provenance, by, file, state.

    ``state``: edge, pending (a call for the conformance retry), unresolved or external (an import outside the module).
    kinds: (id, kind) of nodes.
    """
    target_kind = kinds.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    source_kind = kinds.select(F.col("id").alias("from_id"), F.col("kind").alias("source_kind"))
    # kinds are looked up for the references that ask for them; the others are not dealt again
    none = F.lit(None).cast("string")
    of = lambda *asked: resolved.filter(F.col("kind").isin(*asked))
    r = of("embeds").join(target_kind, "target", "left").join(source_kind, "from_id", "left")
    r = r.unionByName(of("instantiates").join(target_kind, "target", "left").withColumn("source_kind", none))
    rest = resolved.filter(~F.coalesce(F.col("kind").isin("embeds", "instantiates"), F.lit(False)))
    r = r.unionByName(rest.withColumns({"target_kind": none, "source_kind": none}))
    kind, to, src = F.col("kind"), F.col("target_kind"), F.col("source_kind")
    inside = paths.under(F.col("name"), module_path)
    package = node_id(F.lit("package"), F.col("name"), F.col("name"))
    found = F.col("target").isNotNull()
    state = (
        F.when(kind == "imports", F.when(inside, "edge").otherwise("external"))
        .when(~found & (kind == "calls"), "pending")
        .when(~found, "unresolved")
        .when((kind == "instantiates") & ~to.eqNullSafe("struct"), "unresolved")
        .when((kind == "contains") & (F.col("pkg_alias") != ""), "unresolved")
        .otherwise("edge")
    )
    declared = F.when(to.eqNullSafe("interface") & ~src.eqNullSafe("interface"), "implements").when(~to.eqNullSafe("interface"), "extends")
    made = F.when(kind == "embeds", F.coalesce(declared, F.lit("embeds"))).otherwise(kind)
    swap = kind == "contains"
    return r.select(
        F.when(swap, F.col("target")).otherwise(F.col("from_id")).alias("source"),
        F.when(swap, F.col("from_id")).when(kind == "imports", package).otherwise(F.col("target")).alias("target"),
        made.alias("kind"),
        F.when(swap, 0).otherwise(F.col("line")).alias("line"),
        F.when(swap, 0).otherwise(F.col("col")).alias("col"),
        F.when(made.isin("implements", "extends"), "heuristic").otherwise("ast").alias("provenance"),
        F.when(made.isin("implements", "extends"), F.concat(F.lit("declared-"), made)).otherwise("").alias("by"),
        "file",
        "name",
        "from_id",
        state.alias("state"),
    )


def collapse(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge a (source, kind, target): the least by file of the source, line, column. A partial aggregate."""
    where = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("_file"))
    rest = [c for c in edges.columns if c not in ("source", "kind", "target")]
    carried = [F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in rest]
    placed = edges.join(where, "source", "left").withColumn("_file", F.coalesce("_file", F.lit("")))
    order = F.struct("_file", "line", "col", *[c for c in rest if c not in ("line", "col", "metadata")])
    kept = placed.groupBy("source", "kind", "target").agg(F.min_by(F.struct(*carried), order).alias("e"))
    out = [F.from_json("e.metadata", "map<string,string>").alias("metadata") if c == "metadata" else F.col(f"e.{c}") for c in rest]
    return kept.select("source", "kind", "target", *out).select(*edges.columns)


@dataclass
class Resolved:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    unresolved: DataFrame
    outcome: DataFrame


def as_edges(rows: DataFrame) -> DataFrame:
    """Rows with a ``by`` column as edges with metadata."""
    meta = F.when(F.col("by") != "", F.create_map(F.lit("synthesizedBy"), F.col("by"))).otherwise(F.create_map().cast("map<string,string>"))
    return schema.conform(rows.withColumn("metadata", meta), schema.EDGES)


def resolve(
    nodes: DataFrame, intra: DataFrame, refs: DataFrame, imports: DataFrame, iface_methods: DataFrame, method_arity: DataFrame,
    files: DataFrame, module_path: str, known: DataFrame | None = None, stale: DataFrame | None = None,
) -> Resolved:
    """Nodes, collapsed edges, file rows with counts, and unresolved references of extracted tables.

    files: the files table plus module_key. Order of synthesis: declared and resolved edges, structural implements,
    overrides, then the retry of calls through supertypes. ``known``: outcomes of an earlier version; with it only references
    of ``stale`` files (file) are looked up, in an index of the names they ask for, and the others keep their outcome.
    """
    good = files.filter(F.size("errors") == 0).select(F.col("path").alias("file_path"), "module_key")
    every = nodes.unionByName(package_nodes(refs, module_path))
    kinds = nodes.select("id", "kind")
    asking, through, named = refs, imports, nodes
    if known is not None:
        asking, through = written(refs.join(stale, "file", "left_semi")), imports.join(stale, "file", "left_semi")
        named = nodes.join(asking.select("name").distinct(), "name", "left_semi")
    outcome = reference_edges(resolve_names(asking, through, symbol_index(named, good)), kinds, module_path)
    if known is not None:
        outcome = known.join(stale, "file", "left_anti").select(*outcome.columns).unionByName(outcome)
    outcome = written(outcome)
    direct = as_edges(outcome.filter("state = 'edge'"))
    base = written(intra.unionByName(direct))
    implements = synthesis.structural_implements(base, nodes, iface_methods, method_arity)
    base = written(base.unionByName(as_edges(implements)))
    overrides = written(as_edges(synthesis.overrides(base, nodes, method_arity)))
    retried = written(synthesis.retry_calls(outcome.filter("state = 'pending'"), base, nodes))
    edges = collapse(base.unionByName(overrides).unionByName(as_edges(retried.filter("target is not null"))), every)
    left = outcome.filter("state = 'unresolved'").select("file", "from_id", "name", "kind").union(
        retried.filter("target is null").select("file", "from_id", "name", "kind")
    )
    counted = count_per_file(files, nodes, intra, outcome.filter("state = 'edge'").select("file").union(retried.filter("target is not null").select("file")))
    return Resolved(every.dropDuplicates(["id"]), edges, counted, left, outcome)


def count_per_file(files: DataFrame, nodes: DataFrame, intra: DataFrame, resolved: DataFrame) -> DataFrame:
    """files with node_count and edge_count (edges inside the file plus those its references gave, before collapse)."""
    n = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    own = intra.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source").select("path")
    e = own.union(resolved.select(F.col("file").alias("path"))).groupBy("path").agg(F.count(F.lit(1)).alias("e"))
    joined = files.drop("node_count", "edge_count").join(n, "path", "left").join(e, "path", "left")
    return joined.withColumns({"node_count": F.coalesce("n", F.lit(0)), "edge_count": F.coalesce("e", F.lit(0))}).drop("n", "e")
