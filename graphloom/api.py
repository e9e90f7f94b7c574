"""CodeGraph: index a tree, keep it fresh, ask it. Every query returns a DataFrame over one pinned snapshot."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .ingest import extract
from .operators import explore, files, lookup, resolve, status, sync, traverse
from .sources import discover
from .sources.shared import written
from .sources.snapshot import Snapshots, export, load, meta_row

#: Tables of a version that a later sync starts from.
KEPT = (
    "nodes", "edges", "intra", "pass1_nodes", "routes", "sources", "refs", "imports", "iface_methods", "method_arity", "outcome", "context",
)


class CodeGraph:
    def __init__(self, spark: SparkSession, store: str, version: int | None = None):
        self.spark, self.store = spark, Snapshots(spark, store)
        self.version = self.store.current() if version is None else version

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.version)

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @property
    def files_table(self) -> DataFrame:
        return self.table("files")

    def views(self) -> None:
        """Temp views nodes, edges, files and meta for SQL."""
        for name in ("nodes", "edges", "files", "meta"):
            self.table(name).createOrReplaceTempView(name)

    # ---- building ---------------------------------------------------------------------------------------------------

    def index(self, root: str) -> int:
        """Full run over a source tree; returns the new version."""
        sources, found = discover.sources(self.spark, root)
        return self.index_sources(written(sources), discover.go_module(found), discover.manifest_text(found), discover.script_options(found))

    def index_sources(self, sources: DataFrame, module_path: str = "", manifest: str = "", script: dict | None = None) -> int:
        return self._build(sources, written(extract.extract(sources, manifest, script)), module_path)

    def _build(self, sources: DataFrame, extracted: DataFrame, module_path: str, old: dict | None = None) -> int:
        """Resolves extracted rows, joined with kept rows of an older version, and commits the result."""
        part = lambda name: extract.table(extracted, name)
        tables = {k: part(k) for k in ("nodes", "edges", "refs", "imports", "iface_methods", "method_arity")}
        files_table = extract.file_rows(sources, extracted)
        if old:
            tables = {k: old[k].unionByName(v.select(*old[k].columns)) for k, v in tables.items()}
            files_table = old["files"].unionByName(files_table.select(*old["files"].columns))
            sources = old["sources"].unionByName(sources.select(*old["sources"].columns))
        tables = {k: written(v) for k, v in tables.items()}
        made = resolve.resolve(
            tables["nodes"], tables["edges"], tables["refs"], tables["imports"], tables["iface_methods"], tables["method_arity"],
            written(files_table), module_path, *((old["outcome"], old["stale"]) if old and "stale" in old else ()),
        )
        route_rows = part("routes")
        if old:
            route_rows = old["routes"].unionByName(route_rows)
        route_rows = written(route_rows)
        route_nodes, route_edges = extract.route_graph(route_rows, made.nodes)
        nodes = written(made.nodes.unionByName(route_nodes))
        edges = written(made.edges.unionByName(route_edges))
        self.unresolved = made.unresolved
        self.version = self.store.write(
            {
                "nodes": nodes, "edges": edges, "files": made.files, "meta": meta_row(self.spark, nodes, edges),
                "intra": tables["edges"], "pass1_nodes": tables["nodes"], "routes": route_rows, "sources": sources,
                "outcome": made.outcome, "context": self.spark.createDataFrame([(module_path,)], "module_path string"),
                **{k: tables[k] for k in ("refs", "imports", "iface_methods", "method_arity")},
            }
        )
        return self.version

    def sync(self, root: str) -> DataFrame:
        """Brings the index up to date with a tree; returns path, state of what changed."""
        sources, found = discover.sources(self.spark, root)
        return self.sync_sources(written(sources), discover.go_module(found), discover.manifest_text(found), discover.script_options(found))

    def sync_sources(self, sources: DataFrame, module_path: str = "", manifest: str = "", script: dict | None = None) -> DataFrame:
        """Extracts added and modified files and looks up what depends on them: the same as a full run."""
        meta = self.table("meta") if self.version else None
        if sync.needs_full_run(meta):
            self.index_sources(sources, module_path, manifest, script)
            return sources.select("path", F.lit("added").alias("state"))
        changed = written(sync.changes(self.files_table, sources).filter("state <> 'unchanged'"))
        states = {r["state"] for r in changed.select("state").distinct().collect()}  # four states at most
        if not states:
            return changed
        if states == {"touched"}:
            stat = sources.select("path", F.col("mtime_unix_ns").alias("_m"), F.col("size_bytes").alias("_s"))
            fresh = self.files_table.join(stat, "path", "left").withColumns(
                {"mtime_unix_ns": F.coalesce("_m", "mtime_unix_ns"), "size_bytes": F.coalesce("_s", "size_bytes")}
            )
            kept = {k: self._read_any(k) for k in KEPT if self.store.has(k, self.version)}
            self.version = self.store.write({**kept, "files": fresh.drop("_m", "_s"), "meta": meta_row(self.spark, kept["nodes"], kept["edges"])})
            return changed
        replaced = changed.filter("state IN ('modified', 'deleted', 'touched')").select("path")
        batch = sources.join(changed.filter("state IN ('added', 'modified', 'touched')").select("path"), "path", "left_semi")
        extracted = written(extract.extract(batch.select(*sources.columns), manifest, script))
        kept_nodes = sync.prune_nodes(self._read_any("pass1_nodes"), replaced)
        ids = kept_nodes.select("id")
        keep = lambda df, column: df.join(replaced.withColumnRenamed("path", column), column, "left_anti").select(*df.columns)
        old = {
            "nodes": kept_nodes,
            "edges": sync.prune_edges(self._read_any("intra"), self._read_any("pass1_nodes"), replaced),
            "refs": keep(self.table("refs"), "file"),
            "imports": keep(self.table("imports"), "file"),
            "iface_methods": self.table("iface_methods").join(ids.withColumnRenamed("id", "iface_id"), "iface_id", "left_semi").select("iface_id", "name", "arity"),
            "method_arity": self.table("method_arity").join(ids.withColumnRenamed("id", "method_id"), "method_id", "left_semi").select("method_id", "arity"),
            "files": keep(self.files_table, "path"),
            "routes": keep(self._read_any("routes"), "file"),
            "sources": keep(self.table("sources"), "path"),
        }
        if self.store.has("outcome", self.version) and self._read_any("context").first()["module_path"] == module_path:
            keys = lambda df, modules: df.join(modules, "file_path").select("module_key", "name")
            held = self._read_any("pass1_nodes").join(replaced.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
            held = keys(held, self.files_table.select(F.col("path").alias("file_path"), "module_key"))
            holds = keys(extract.table(extracted, "nodes"), batch.select(F.col("path").alias("file_path"), "module_key"))
            asked = resolve.lookups(old["refs"], old["imports"])
            old["stale"] = written(sync.stale_files(asked, held.union(holds), changed))
            old["outcome"] = self._read_any("outcome")
        self._build(batch.select(*sources.columns), extracted, module_path, old)
        return changed

    def _read_any(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/v={self.version}/{name}")

    def export(self, path: str) -> None:
        export({k: self.table(k) for k in ("meta", "nodes", "edges", "files")}, path)

    def import_from(self, path: str) -> int:
        tables = load(self.spark, path)
        self.version = self.store.write(tables)
        return self.version

    # ---- queries ----------------------------------------------------------------------------------------------------

    def query(self, term: str, kind: str = "", limit: int | None = None) -> DataFrame:
        return lookup.query(self.nodes, term, kind, limit)

    def search(self, term: str, kind: str = "", limit: int | None = None) -> DataFrame:
        return lookup.search(self.nodes, term, kind, limit)

    def callers(self, symbol: str, limit: int | None = None) -> DataFrame:
        return traverse.callers(self.nodes, self.edges, symbol, limit)

    def callees(self, symbol: str, limit: int | None = None) -> DataFrame:
        return traverse.callees(self.nodes, self.edges, symbol, limit)

    def impact(self, symbol: str, depth: int | None = None) -> DataFrame:
        return traverse.impact(self.nodes, self.edges, symbol, depth)

    def affected(self, changed: list[str], depth: int | None = None, pattern: str = "") -> DataFrame:
        tests = traverse.affected(self.nodes, self.edges, discover.change_list(changed), depth)
        if pattern:
            from .functions.paths import glob_regex

            tests = tests.filter(F.col("file_path").rlike(glob_regex(pattern)))
        return tests

    def files(self, language: str = "", directory: str = "", pattern: str = "", max_depth: int = 0, limit: int | None = None) -> DataFrame:
        return files.files(self.files_table, language, directory, pattern, max_depth, limit)

    def tree(self, **how) -> DataFrame:
        return files.tree(self.files(**how))

    def status(self) -> DataFrame:
        return status.status(self.nodes, self.edges, self.files_table)

    def is_stale(self, root: str, pending: bool = False) -> bool:
        disk = discover.discover(self.spark, root)
        return bool(status.staleness(disk, self.table("meta"), pending).first()["stale"])

    def node(self, symbol: str, file: str = "", line: int = 0) -> DataFrame:
        """Definitions of a symbol, narrowed by hints, with bodies and which of them a display has room for."""
        from .operators import detail

        if file and not line:
            exact = lookup.definition_in_file(self.nodes, symbol, file)
            if not exact.isEmpty():
                return detail.bodies(exact.withColumn("pos", F.lit(1)), self.table("sources")).withColumn("shown", F.lit(True))
        defs = detail.bodies(lookup.narrow(lookup.definitions(self.nodes, symbol), file, line), self.table("sources"))
        return defs.join(detail.within_budget(defs).drop("name"), "pos").orderBy("pos")

    def source(self, path: str, first: int = 1, last: int = 0) -> DataFrame:
        """Numbered lines of an indexed file; only paths of the snapshot can be read."""
        return files.numbered(self.table("sources"), path, first, last)

    def explore(self, query: str, max_files: int = 0) -> explore.Exploration:
        project = re.sub(r".*/", "", self.store.root)
        return explore.explore(written(self.nodes), written(self.edges), query, max_files, project)


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: schema.empty(spark, s) for k, s in (("nodes", schema.NODES), ("edges", schema.EDGES), ("files", schema.FILES), ("meta", schema.META))}
