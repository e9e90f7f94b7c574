"""Exact, lexical and hinted look-ups of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import FILTER_KINDS

MAX_LIMIT, MAX_DEPTH, MAX_FILES, MAX_AFFECTED_FILES = 1000, 50, 1000, 10_000
IMPACT_DEPTH, AFFECTED_DEPTH, EXPLORE_FILES = 2, 5, 5


def clamp_limit(limit: int | None) -> int:
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit or MAX_LIMIT, MAX_LIMIT)


def clamp_depth(depth: int | None, default: int) -> int:
    if depth is not None and depth < 0:
        raise ValueError("depth must not be negative")
    return min(depth or default, MAX_DEPTH)


def check_kind(kind: str) -> str:
    if kind and kind not in FILTER_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return kind


def check_term(term: str) -> str:
    if not term.strip():
        raise ValueError("the term must not be blank")
    return term


def match_tier(term: str, *columns: Column) -> Column:
    """0 equal, 1 prefix, 2 substring, 3 none: the best of the columns; case counts."""
    t = F.lit(term)
    tiers = [F.when(c == t, 0).when(F.startswith(c, t), 1).when(F.contains(c, t), 2).otherwise(3) for c in columns]
    return F.least(*tiers) if len(tiers) > 1 else tiers[0]


def query(nodes: DataFrame, term: str, kind: str = "", limit: int | None = None) -> DataFrame:
    """Full rows that match, best tier first, with the tier."""
    check_term(term)
    if check_kind(kind):
        nodes = nodes.filter(F.col("kind") == kind)
    found = nodes.withColumn("tier", match_tier(term, F.col("name"), F.col("qualified_name"))).filter("tier < 3")
    return found.orderBy("tier", "qualified_name", "id").limit(clamp_limit(limit))


def search(nodes: DataFrame, term: str, kind: str = "", limit: int | None = None) -> DataFrame:
    return query(nodes, term, kind, limit).select("name", "kind", "file_path", "start_line")


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """The node of that exact name with the lowest id: one row or none."""
    rows = nodes.filter(F.col("name") == check_term(symbol))
    return rows.agg(F.min_by(F.struct(*nodes.columns), "id").alias("n")).filter("n is not null").select("n.*")


def definitions(nodes: DataFrame, symbol: str) -> DataFrame:
    """Every definition of a name with ``pos``: hand-written files first, then by id."""
    rows = nodes.filter(F.col("name") == check_term(symbol)).withColumn("generated", paths.is_generated(F.col("file_path")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("name").orderBy("generated", "id")))


def narrow(defs: DataFrame, file_hint: str = "", line_hint: int = 0) -> DataFrame:
    """Definitions that fit a file and a line hint; a hint that fits nothing is dropped, so this never empties."""
    if file_hint:
        hint = file_hint.replace("\\", "/").lower()
        path = paths.normal(F.col("file_path"))
        exact = path == hint
        loose = F.endswith(path, F.lit(hint)) | F.contains(path, F.lit(hint))
        defs = _if_any(defs, exact | loose)
    if line_hint:
        inside = (F.col("start_line") <= line_hint) & (F.col("end_line") >= line_hint)
        whole = Window.partitionBy("name")
        near = F.row_number().over(whole.orderBy(F.abs(F.col("start_line") - line_hint), "pos")) == 1
        defs = defs.withColumns({"_in": inside, "_near": near}).withColumn("_any", F.max("_in").over(whole))
        defs = defs.filter(F.when(F.col("_any"), F.col("_in")).otherwise(F.col("_near"))).drop("_in", "_near", "_any")
    return defs.orderBy("pos")


def _if_any(defs: DataFrame, fits: Column) -> DataFrame:
    fitted = defs.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("name")))
    return fitted.filter(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")


def definition_in_file(nodes: DataFrame, symbol: str, path: str) -> DataFrame:
    """The definition of a name in exactly that file, lowest id."""
    return resolve_symbol(nodes.filter(F.col("file_path") == path), symbol)
