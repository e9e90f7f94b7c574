"""Queries over the steps that score, drop, rescue, order and show files of an exploration, each with DuckDB SQL.

Node scores and file scores are made from line numbers and counts, so that both engines sum the same fractions of two exactly.
Constants are written out in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import explore, scoring
from ..sources.shared import written
from .catalog import graph, query
from .fixtures import _values

_FILES = """fs AS (SELECT file_path, sum((start_line % 13)::DOUBLE / CASE WHEN length(file_path) % 5 = 0 THEN 8 ELSE 512 END) AS mass,
  count(*) AS n_nodes, count(*) % 4 AS hits, (count(*) % 12 + CASE WHEN count(*) % 7 = 0 THEN 50 ELSE 0 END)::DOUBLE AS score, file_path LIKE '%\\_test.go' ESCAPE '\\' AS low_value FROM nodes WHERE file_path <> '' GROUP BY file_path)"""


def _scores(nodes: DataFrame) -> DataFrame:
    """Much for nodes of every fifth length of path, little for the others."""
    share = F.when(F.length("file_path") % 5 == 0, 8).otherwise(512)
    return nodes.select("id", ((F.col("start_line") % 13) / share).alias("score"))


def _parts(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """score, mass, hits and n_nodes of every file."""
    n = written(nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_nodes")))
    scores = n.select("file_path", (F.col("n_nodes") % 12 + F.when(F.col("n_nodes") % 7 == 0, 50).otherwise(0)).cast("double").alias("score"))
    return scores, written(scoring.file_mass(nodes, _scores(nodes))), n.select("file_path", (F.col("n_nodes") % 4).alias("hits")), n


@query(f"WITH {_FILES} SELECT file_path, mass FROM fs")
def file_mass(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return scoring.file_mass(nodes, _scores(nodes))


@query(f"""WITH {_FILES} SELECT 'how it works' AS asked, file_path, score FROM fs WHERE NOT low_value
UNION ALL SELECT 'the Tests of it', file_path, score FROM fs""")
def files_without_tests(spark, sf_dir) -> DataFrame:
    """Test files go unless the query says test and two others remain."""
    scores = _parts(graph(spark, sf_dir)[0])[0]
    one = lambda q: scoring.exclude_tests(scores, q).select(F.lit(q).alias("asked"), "file_path", "score")
    return one("how it works").union(one("the Tests of it"))


@query(f"""WITH {_FILES}, kept AS (SELECT file_path, score FROM fs WHERE score >= 10), t AS (
  SELECT DISTINCT n.file_path FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes n ON n.id = e.target
  WHERE e.kind IN ('references', 'type_of', 'returns') AND s.start_line % 7 = 0
), buried AS (SELECT file_path FROM t JOIN fs USING (file_path) WHERE mass < 0.06 * (SELECT max(mass) FROM fs) AND hits < 2)
SELECT file_path, CASE WHEN b.file_path IS NULL THEN k.score ELSE greatest(coalesce(k.score, 0), 45.0) END AS score, b.file_path IS NOT NULL AS rescued
FROM kept k FULL JOIN buried b USING (file_path)""")
def files_rescued(spark, sf_dir) -> DataFrame:
    """Files of signature types with little mass and few hits come back."""
    nodes, edges = graph(spark, sf_dir)
    scores, mass, hits, _ = _parts(nodes)
    return scoring.rescue(scores.filter("score >= 10"), mass, hits, nodes, edges, nodes.filter("start_line % 7 = 0"))


def _profiles(spark, sf_dir) -> DataFrame:
    scores, mass, hits, n = _parts(graph(spark, sf_dir)[0])
    return scoring.profile(scores.withColumn("rescued", F.col("score") == 7), mass, hits, n)


_PROFILES = f"""{_FILES}, top AS (SELECT file_path FROM fs WHERE hits >= 1 ORDER BY mass DESC, file_path LIMIT 2
), p AS (SELECT file_path, score, score = 7 AS rescued, mass, hits, n_nodes, file_path IN (SELECT file_path FROM top) AS central, low_value FROM fs)"""


@query(f"WITH {_PROFILES} SELECT file_path, score, rescued, mass, hits, n_nodes, central FROM p")
def files_central(spark, sf_dir) -> DataFrame:
    """All files with what the gate looks at; the two of most mass among those with a hit are central."""
    return _profiles(spark, sf_dir)


@query(f"""WITH {_PROFILES}, g AS (SELECT *, mass >= 0.06 * max(mass) OVER () OR central OR score >= 10 OR rescued OR hits >= 2 AS pass FROM p)
SELECT file_path FROM g WHERE pass OR (SELECT count(*) FROM g WHERE pass) < 2 OR (SELECT max(mass) FROM g) <= 0""")
def files_gated(spark, sf_dir) -> DataFrame:
    return scoring.gate(_profiles(spark, sf_dir)).select("file_path")


@query(f"""WITH {_PROFILES}, q AS (SELECT *, (n_nodes % 5)::DOUBLE AS m FROM p)
SELECT file_path, row_number() OVER (ORDER BY score >= 50 DESC, (score >= 10 OR central) AND hits >= 2 DESC, m DESC, hits DESC, low_value, score DESC, n_nodes DESC, file_path) AS pos FROM q""")
def files_ordered(spark, sf_dir) -> DataFrame:
    """Display order where masses are equal or further apart than the band, so that the order is strict."""
    p = _profiles(spark, sf_dir).withColumns(
        {"mass": (F.col("n_nodes") % 5).cast("double"), "low_value": F.col("file_path").endswith("_test.go"), "generated": F.lit(False)}
    )
    rows = scoring.order_files([r.asDict() for r in p.orderBy("file_path").collect()])  # a row a file of the projection
    return spark.createDataFrame([(r["file_path"], k + 1) for k, r in enumerate(rows)], "file_path string, pos long")


@query("""WITH wide AS (SELECT target FROM edges WHERE kind = 'implements' GROUP BY target HAVING count(DISTINCT source) >= 3)
SELECT DISTINCT file_path FROM nodes WHERE id IN (SELECT source FROM edges WHERE kind = 'implements' AND target IN (SELECT target FROM wide))
AND file_path <> 'europe/nation_3/urgent.go'""")
def files_skeleton(spark, sf_dir) -> DataFrame:
    """Files off the spine with a type behind an interface of three or more implementers."""
    nodes, edges = graph(spark, sf_dir)
    spine = spark.createDataFrame([("europe/nation_3/urgent.go",)], "file_path string")
    return scoring.skeleton_files(nodes, spine, edges)


@query(_values("indexed, shown", [(1, 3), (20, 3), (21, 5), (100, 5), (101, 8), (500, 8), (501, 12), (100000, 12)]), graph=False)
def files_budget(spark, sf_dir) -> DataFrame:
    sizes = (1, 20, 21, 100, 101, 500, 501, 100_000)
    return spark.createDataFrame([(n, scoring.file_budget(n)) for n in sizes], "indexed int, shown int")


_SMALL_NODES = [
    ("s", "struct", "Ledger", "ledger/ledger.go", 1), ("m", "method", "Post", "ledger/ledger.go", 5), ("c", "function", "CloseDay", "orders/close.go", 1),
    ("t", "function", "TestClose", "orders/close_test.go", 1), ("z", "function", "unrelated", "misc/z.go", 1),
]
_SMALL_EDGES = [("s", "contains", "m"), ("c", "calls", "m"), ("t", "calls", "c"), ("c", "instantiates", "s")]


@query(_values("file_path, position, id, callers, test_files", [
    ("ledger/ledger.go", 0, "m", 1, ""), ("ledger/ledger.go", 0, "s", 0, ""), ("orders/close.go", 1, "c", 1, "orders/close_test.go"),
]), graph=False)
def files_grouped(spark, sf_dir) -> DataFrame:
    """Symbols of an authored graph by file: matches of the query, else a file's node of most mass; tests are left out."""
    from .. import schema

    nodes = spark.createDataFrame(_SMALL_NODES, "id string, kind string, name string, file_path string, start_line int")
    nodes = schema.conform(nodes.withColumn("qualified_name", F.col("name")), schema.NODES)
    edges = schema.conform(spark.createDataFrame(_SMALL_EDGES, "source string, kind string, target string"), schema.EDGES)
    found = explore.explore(nodes, edges, "Ledger Post").symbols
    place = F.dense_rank().over(Window.orderBy("position")) - 1  # files shown, by their place in the order
    return found.select("file_path", place.alias("position"), "id", "callers", F.array_join("test_files", ",").alias("test_files"))
