"""The extraction step: a table of sources in, nodes, edges, references and routes out.

Each file is parsed alone in the task that holds it; an extractor that fails leaves its message in the file's row and
never ends a batch. Languages are entries of a registry that users may add to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..functions.hashing import content_hash, node_id
from . import brace_source, python_source, routes
from .rows import FileRows

#: Source bytes whose rows are sent on together.
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class Language:
    id: str
    extensions: tuple[str, ...]
    extract: Callable[[FileRows, str], None]


LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> None:
    LANGUAGES[language.id] = language


for _id, _extensions in {
    "go": (".go",), "python": (".py",), "java": (".java",), "csharp": (".cs",), "typescript": (".ts", ".mts", ".cts"), "tsx": (".tsx",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"), "c": (".c", ".h"), "cpp": (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"),
    "kotlin": (".kt", ".kts"), "php": (".php",), "ruby": (".rb",), "rust": (".rs",), "swift": (".swift",),
}.items():
    _special = {"go": brace_source.extract_go, "python": python_source.extract, "ruby": brace_source.extract_ruby}
    register(Language(_id, _extensions, _special.get(_id, brace_source.extract)))


def language_of(path: Column) -> Column:
    """Language by lower-cased extension; empty if none is registered."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for lang in LANGUAGES.values() for e in lang.extensions for x in (e, lang.id)])
    return F.coalesce(F.element_at(table, extension), F.lit(""))


_ROUTES = schema._table(
    framework=T.StringType(), file=T.StringType(), language=T.StringType(), verb=T.StringType(), route=T.StringType(),
    handler=T.StringType(), handler_id=T.StringType(), line=T.IntegerType(), col=T.IntegerType(),
)
_PARTS = {
    "nodes": schema.NODES, "edges": schema.EDGES, "refs": schema.REFS, "imports": schema.IMPORTS,
    "iface_methods": schema.IFACE_METHODS, "method_arity": schema.METHOD_ARITY, "routes": _ROUTES,
}
EXTRACTED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("path", "language", "module_key", "error")]
    + [T.StructField(k, T.ArrayType(v)) for k, v in _PARTS.items()]
)


def extract_file(path: str, language: str, module_key: str, content: bytes, manifest: str = "", script: dict | None = None) -> dict:
    """One file's rows; errors are kept as text. script: compiler options that tell where script modules lie."""
    out = FileRows(path, language, module_key)
    out.script = script or {}
    found: list[dict] = []
    try:
        text = content.decode("utf-8", errors="replace")
        LANGUAGES[language].extract(out, text)
        found = routes.rows(path, language, text, manifest, out.nodes) if manifest else []
    except Exception as why:  # noqa: BLE001  one bad file must not end the batch
        out.error = f"{type(why).__name__}: {why}"[:500]
    lines = content.count(b"\n") + 1
    out.nodes[0]["end_line"] = lines
    return {**out.row(), "routes": found}


def _kernel(manifest: str, script: dict | None):
    arrow = to_arrow_schema(EXTRACTED)

    def run(batches):
        for batch in batches:
            made: list[dict] = []
            size = 0
            for path, language, key, content in zip(*(batch.column(k) for k in range(4)), strict=True):
                content = content.as_py() or b""
                made.append(extract_file(path.as_py(), language.as_py(), key.as_py(), content, manifest, script))
                size += len(content)
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return run


def extract(sources: DataFrame, manifest: str = "", script: dict | None = None) -> DataFrame:
    """sources (path, language, module_key, content) -> one row a file with arrays of rows."""
    known = sources.filter(F.col("language").isin(list(LANGUAGES)))
    return known.select("path", "language", "module_key", "content").mapInArrow(_kernel(manifest, script), EXTRACTED)


def table(extracted: DataFrame, part: str) -> DataFrame:
    """One of the tables inside extracted rows."""
    return extracted.select(F.explode(part).alias("r")).select("r.*")


def file_rows(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """The files table (counts still zero), with module_key as extraction left it."""
    stat = sources.select("path", content_hash(F.col("content")).alias("content_hash"), "mtime_unix_ns", "size_bytes")
    errors = F.when(F.col("error") != "", F.array("error")).otherwise(F.array().cast("array<string>"))
    rows = extracted.select("path", "language", "module_key", errors.alias("errors")).join(stat, "path")
    keys = rows.select("path", "module_key")
    return schema.conform(rows, schema.FILES).join(keys, "path")


def route_graph(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes and their calls edges; a handler the file does not declare is the lowest id of that name."""
    named = nodes.filter("kind IN ('function', 'method')").groupBy(F.col("name").alias("handler")).agg(F.min("id").alias("by_name"))
    joined = found.join(named, "handler", "left")
    handler = F.when(F.col("handler_id") != "", F.col("handler_id")).otherwise(F.col("by_name"))
    title = F.concat_ws(" ", "verb", "route")
    qualified = F.concat("file", F.lit("::route:"), title)
    rows = joined.withColumns({"target": handler, "name": title, "qualified_name": qualified}).filter("target is not null")
    rows = rows.withColumn("id", node_id(F.lit("route"), F.col("qualified_name"), F.col("file")))
    made = rows.select(
        "id", F.lit("route").alias("kind"), "name", "qualified_name", F.col("file").alias("file_path"), "language",
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.col("col").alias("start_col"),
    )
    meta = F.create_map(
        F.lit("synthesizedBy"), F.concat("framework", F.lit("-route")), F.lit("httpMethod"), "verb", F.lit("routePath"), "route"
    )
    edges = rows.select(
        F.col("id").alias("source"), "target", F.lit("calls").alias("kind"), "line", "col", F.lit("heuristic").alias("provenance"), meta.alias("metadata")
    )
    return schema.conform(made, schema.NODES).dropDuplicates(["id"]), schema.conform(edges, schema.EDGES)
