"""Tables of the graph, their columns and vocabularies. Columns are never null: unset is "", 0, false or empty."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


NODES = _table(
    id=S, kind=S, name=S, qualified_name=S, file_path=S, language=S, start_line=I, end_line=I, start_col=I, end_col=I,
    signature=S, docstring=S, visibility=S, is_exported=B, return_type=S,
)
EDGES = _table(
    source=S, target=S, kind=S, line=I, col=I, provenance=S, metadata=T.MapType(S, S)
)
FILES = _table(
    path=S, content_hash=S, language=S, node_count=L, edge_count=L, errors=T.ArrayType(S), mtime_unix_ns=L, size_bytes=L
)
META = _table(
    schema_version=L, node_count=L, edge_count=L, last_sync_unix_ms=L, healthy=B, health_message=S, has_file_index=B
)
#: What extraction gives besides nodes and edges inside a file. ``seq`` keeps the order of references in a file.
REFS = _table(file=S, module_key=S, from_id=S, name=S, pkg_alias=S, kind=S, line=I, col=I, seq=L)
IMPORTS = _table(file=S, alias=S, target_module=S)
IFACE_METHODS = _table(iface_id=S, name=S, arity=I)
METHOD_ARITY = _table(method_id=S, arity=I)
SOURCES = _table(
    path=S, language=S, module_key=S, content=T.BinaryType(), mtime_unix_ns=L, size_bytes=L
)

SCHEMA_VERSION = 1
NODE_KINDS = ("file", "function", "method", "struct", "interface", "type_alias", "constant", "variable", "route", "package")
#: Kinds that a filter may name: all but route.
FILTER_KINDS = tuple(k for k in NODE_KINDS if k != "route")
DEFINITION_KINDS = ("struct", "interface", "type_alias")
RANK_EDGES = (
    "calls", "references", "extends", "implements", "overrides", "instantiates", "returns", "type_of", "imports",
)
EDGE_KINDS = (*RANK_EDGES, "contains", "embeds")
HIERARCHY_EDGES = ("extends", "implements")
SIGNATURE_EDGES = ("references", "type_of", "returns")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, cast, with unset values for missing ones and nulls; other columns go."""
    unset = {"string": "", "int": 0, "bigint": 0, "boolean": False}
    out = []
    for field in schema:
        kind = field.dataType.simpleString()
        if kind in unset:
            default = F.lit(unset[kind]).cast(kind)
        elif isinstance(field.dataType, T.MapType):
            default = F.create_map().cast(kind)
        elif isinstance(field.dataType, T.ArrayType):
            default = F.array().cast(kind)
        else:
            default = F.lit(b"").cast(kind)
        have = F.coalesce(F.col(field.name).cast(field.dataType), default) if field.name in df.columns else default
        out.append(have.alias(field.name))
    return df.select(*out)


def edge_order(*columns: str) -> list:
    """Scan order of stored keys: shorter strings first, then bytes, column by column."""
    return [x for c in columns for x in (F.octet_length(c), F.col(c))]
