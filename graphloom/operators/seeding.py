"""Named seeds: symbols that a query spells out, with rules for overloaded names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written
from .traverse import calls, method_owners

# Fixed values of the seeding rules.
LEAST_BYTES, MOST_TOKENS, SMALL_DEFS, CALLER_RATIO, OWNED_CAP = 3, 16, 3, 0.25, 4


def seed_tokens(query: str) -> list[str]:
    return [t for t in text.symbol_tokens(query) if len(t.encode()) >= LEAST_BYTES][:MOST_TOKENS]


def type_tokens(query: str, project: str = "") -> list[str]:
    """PascalCase tokens but the project's own name."""
    return [
        t
        for t in text.symbol_tokens(query)
        if re.fullmatch(r"[A-Z][a-zA-Z0-9]*", t) and not (project and t.lower() == project.lower())
    ]


def line_span(start, end):
    return F.greatest(F.lit(0), end - start + 1)


def named_seeds(nodes: DataFrame, edges: DataFrame, query: str, project: str = "") -> DataFrame:
    """token, id, is_primary. Up to three definitions: all, primary are the lowest id and those with enough callers.

    More: definitions owned by a type the query names (the first four), else the one with the most lines. Counts and
    picks are partial aggregates and group-limited windows, so a name with very many definitions is not gathered.
    """
    tokens = seed_tokens(query)
    defs = nodes.filter(F.col("name").isin(tokens)).select(F.col("name").alias("token"), "id", "start_line", "end_line")
    sizes = defs.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    sized = defs.join(sizes, "token")
    few = sized.filter(F.col("n") <= SMALL_DEFS)
    counts = calls(edges).join(few.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("id"))
    few = few.join(counts.agg(F.count(F.lit(1)).alias("callers")), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    most = F.max("callers").over(Window.partitionBy("token"))  # three rows at most
    few = few.select("token", "id", ((F.col("id") == F.col("first")) | (F.col("callers") >= CALLER_RATIO * most)).alias("is_primary"))
    many = sized.filter(F.col("n") > SMALL_DEFS)
    wanted = type_tokens(query, project)
    types = written(nodes.filter(F.col("name").isin(wanted)).select(F.col("id").alias("owner")))
    contains = edges.filter("kind = 'contains'")
    held = written(contains.join(types.withColumnRenamed("owner", "source"), "source", "left_semi").select("target").distinct())
    owners = method_owners(contains.join(held, "target", "left_semi"))  # of what the named types hold, not of everything
    owned = many.join(owners, F.col("id") == F.col("method")).join(types, "owner")
    rank = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    owned = owned.withColumn("r", rank).filter(F.col("r") <= OWNED_CAP).select("token", "id")
    span = F.struct(-line_span(F.col("start_line"), F.col("end_line")), F.col("id"))
    longest = many.groupBy("token").agg(F.min_by("id", span).alias("id"))
    rest = longest.join(owned.select("token").distinct(), "token", "left_anti")
    return few.union(owned.union(rest).withColumn("is_primary", F.lit(True)))
