"""A code graph made from the relational test tables, in SQL that Spark and DuckDB both read.

Nations and order priorities are files, customers are structs, nation and market segment pairs (and regions) are
interfaces, orders are methods, suppliers functions, parts constants. Spark makes the same rows with column expressions:
orders are joined once, and the number of tasks follows the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from .shared import tasks_of, written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_PRIORITY = """CASE o_orderpriority WHEN '5-LOW' THEN 'low_test' ELSE lower(replace(substr(o_orderpriority, 3), ' ', '_')) END"""
CTES = f"""
geo AS (
  SELECT n_nationkey, lower(replace(r_name, ' ', '_')) || '/' || lower(replace(n_name, ' ', '_')) AS dir, n_name, r_name
  FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
), cust AS (
  SELECT c_custkey, c_name, c_mktsegment, dir, n_name, r_name FROM {{customer}} JOIN geo ON c_nationkey = n_nationkey
), ord AS (
  SELECT o_orderkey, o_custkey, c_name, c_mktsegment, n_name, r_name, {_PRIORITY} AS prio, dir || '/' || {_PRIORITY} || '.go' AS path,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order
  FROM {{orders}} JOIN cust ON o_custkey = c_custkey
), raw_nodes AS (
  SELECT 'interface:' || n_name || ':' || c_mktsegment AS id, 'interface' AS kind, c_mktsegment AS name,
         n_name || '.' || c_mktsegment AS qualified_name, dir || '/urgent.go' AS file_path, 1 AS start_line, 9 AS end_line
  FROM cust GROUP BY n_name, c_mktsegment, dir
  UNION ALL SELECT 'interface:' || r_name, 'interface', r_name, r_name, lower(replace(r_name, ' ', '_')) || '/region.go', 1, 5 FROM {{region}}
  UNION ALL SELECT 'struct:' || CAST(c_custkey AS STRING), 'struct', c_name, n_name || '.' || c_name, dir || '/urgent.go',
                   CAST(c_custkey % 500 AS INT) + 10, CAST(c_custkey % 500 + c_custkey % 23 AS INT) + 10 FROM cust
  UNION ALL SELECT 'function:' || CAST(s_suppkey AS STRING), 'function', s_name, 'supply.' || s_name, dir || '/high.go',
                   CAST(s_suppkey % 90 AS INT) + 1, CAST(s_suppkey % 90 + s_suppkey % 17 AS INT) + 1
            FROM {{supplier}} JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT 'constant:' || CAST(p_partkey AS STRING), 'constant', p_name, p_brand || '.' || p_name,
                   'parts/' || lower(replace(p_brand, '#', '_')) || '.go', CAST(p_partkey % 900 AS INT) + 1, CAST(p_partkey % 900 AS INT) + 1
            FROM {{part}}
  UNION ALL SELECT 'method:' || CAST(o_orderkey AS STRING), 'method', prio, c_name || '.' || prio, path,
                   CAST(o_orderkey % 1000 AS INT) + 1, CAST(o_orderkey % 1000 + o_orderkey % 37 AS INT) + 1 FROM ord
), nodes AS (
  SELECT * FROM raw_nodes
  UNION ALL SELECT 'file:' || file_path, 'file', substr(file_path, length(regexp_replace(file_path, '[^/]*$', '')) + 1), file_path, file_path, 1, 1
            FROM raw_nodes GROUP BY file_path
), raw_edges AS (
  SELECT 'method:' || CAST(l_orderkey AS STRING) AS source, 'function:' || CAST(l_suppkey AS STRING) AS target, 'calls' AS kind, l_linenumber AS line, path
  FROM {{lineitem}} JOIN ord ON l_orderkey = o_orderkey
  UNION ALL SELECT 'method:' || CAST(o_orderkey AS STRING), 'method:' || CAST(next_order AS STRING), 'calls', 99, path FROM ord WHERE next_order IS NOT NULL
  UNION ALL SELECT 'method:' || CAST(l_orderkey AS STRING), 'constant:' || CAST(l_partkey AS STRING), 'references', l_linenumber, path
            FROM {{lineitem}} JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION ALL SELECT 'function:' || CAST(s_suppkey AS STRING), 'interface:' || n_name || ':BUILDING', 'type_of', 1, dir || '/high.go'
            FROM {{supplier}} JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT 'function:' || CAST(l_suppkey AS STRING), 'constant:' || CAST(min(l_partkey) AS STRING), 'returns', 2, dir || '/high.go'
            FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN geo ON s_nationkey = n_nationkey GROUP BY l_suppkey, dir
  UNION ALL SELECT 'file:' || dir || '/urgent.go', 'struct:' || CAST(c_custkey AS STRING), 'contains', 1, dir || '/urgent.go' FROM cust
  UNION ALL SELECT 'struct:' || CAST(o_custkey AS STRING), 'method:' || CAST(o_orderkey AS STRING), 'contains', 1, path FROM ord
  UNION ALL SELECT 'struct:' || CAST(c_custkey AS STRING), 'interface:' || n_name || ':' || c_mktsegment, 'implements', 1, dir || '/urgent.go' FROM cust
  UNION ALL SELECT 'interface:' || n_name || ':' || c_mktsegment, 'interface:' || r_name, 'extends', 1, dir || '/urgent.go'
            FROM cust GROUP BY n_name, c_mktsegment, r_name, dir
), edges AS (
  SELECT source, target, kind, min(line) AS line FROM raw_edges GROUP BY source, target, kind
)"""


def oracle(sql: str) -> str:
    """DuckDB text of a query over nodes, edges and raw_edges."""
    names = {t: t for t in TABLES}
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = " RECURSIVE", ", " + body[len("WITH RECURSIVE") :].strip()
    elif body.upper().startswith("WITH"):
        body = ", " + body[len("WITH") :].strip()
    else:
        body = "\n" + body
    return f"WITH{recursive} {CTES.format(**names)}{body}"


def _select(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = CTES.format(**{t: "{" + t + "}" for t in TABLES})
    used = {t: f for t, f in frames.items() if "{" + t + "}" in text}
    return spark.sql(f"WITH {text} SELECT * FROM {what}", **used)


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A projected table is written once a session, as a store is indexed once; queries read the written graph."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = written(build())
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a nation."""
    place = F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    met = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return F.broadcast(met.select("n_nationkey", place.alias("dir"), "n_name", "r_name"))


def _cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "customer").join(geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select("c_custkey", "c_name", "c_mktsegment", "dir", "n_name", "r_name")


def ords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord`` of the SQL: orders with their customer, place and next order. Nodes, edges and references read it."""

    def build():
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr(_PRIORITY).alias("prio"))
        n = tasks_of(orders)
        met = orders.repartition(n, "o_custkey").join(
            _cust(spark, sf_dir).repartition(n, "c_custkey").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")
        )
        following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        path = F.concat("dir", F.lit("/"), "prio", F.lit(".go"))
        return met.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "dir", "prio", path.alias("path"), following.alias("next_order"))

    return kept(spark, sf_dir, "ords", build)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes`` of the SQL."""

    def build():
        cust, nation, ord = _cust(spark, sf_dir), geo(spark, sf_dir), ords(spark, sf_dir)
        region, part = table(spark, sf_dir, "region"), table(spark, sf_dir, "part")
        supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        lines = lambda key, most, more: (f"CAST({key} % {most} AS INT)", f"CAST({key} % {most} + {key} % {more} AS INT)")
        parts = "'parts/' || lower(replace(p_brand, '#', '_')) || '.go'"
        c, s, o = lines("c_custkey", 500, 23), lines("s_suppkey", 90, 17), lines("o_orderkey", 1000, 37)
        names = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line")
        rows = lambda df, *sql: df.selectExpr(*(f"{x} AS {n}" for x, n in zip(sql, names, strict=True)))
        found = [
            rows(cust.select("n_name", "c_mktsegment", "dir").distinct(), "'interface:' || n_name || ':' || c_mktsegment", "'interface'", "c_mktsegment",
                 "n_name || '.' || c_mktsegment", "dir || '/urgent.go'", "1", "9"),
            rows(region, "'interface:' || r_name", "'interface'", "r_name", "r_name", "lower(replace(r_name, ' ', '_')) || '/region.go'", "1", "5"),
            rows(cust, "'struct:' || CAST(c_custkey AS STRING)", "'struct'", "c_name", "n_name || '.' || c_name", "dir || '/urgent.go'", f"{c[0]} + 10", f"{c[1]} + 10"),
            rows(supplier, "'function:' || CAST(s_suppkey AS STRING)", "'function'", "s_name", "'supply.' || s_name", "dir || '/high.go'", f"{s[0]} + 1", f"{s[1]} + 1"),
            rows(part, "'constant:' || CAST(p_partkey AS STRING)", "'constant'", "p_name", "p_brand || '.' || p_name", parts,
                 "CAST(p_partkey % 900 AS INT) + 1", "CAST(p_partkey % 900 AS INT) + 1"),
            rows(ord, "'method:' || CAST(o_orderkey AS STRING)", "'method'", "prio", "c_name || '.' || prio", "path", f"{o[0]} + 1", f"{o[1]} + 1"),
        ]
        every = reduce(DataFrame.union, found)
        files = reduce(DataFrame.union, (x.select("file_path") for x in found)).distinct()
        last = "substr(file_path, length(regexp_replace(file_path, '[^/]*$', '')) + 1)"
        every = every.union(rows(files, "'file:' || file_path", "'file'", last, "file_path", "file_path", "1", "1"))
        return schema.conform(every.withColumn("language", F.lit("go")).withColumn("visibility", F.lit("public")), schema.NODES)

    return kept(spark, sf_dir, "nodes", build)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edges`` of the SQL: made and collapsed on keys as numbers, dealt once by the order. No two branches share a key."""

    def build():
        cust, nation, ord = _cust(spark, sf_dir), geo(spark, sf_dir), ords(spark, sf_dir)
        item, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
        placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "dir").distinct()
        names = ("source", "target", "kind", "line")
        rows = lambda df, *sql: df.selectExpr(*(f"{x} AS {n}" for x, n in zip(sql, names, strict=True)))
        text = lambda kind, key: f"'{kind}:' || CAST({key} AS STRING)"

        n = tasks_of(item)
        lines = item.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag").repartition(n, "l_orderkey")
        lines = lines.join(ord.select("o_orderkey").repartition(n, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        both = "CASE WHEN l_returnflag = 'R' THEN array(struct(true AS call, l_suppkey AS t), struct(false AS call, l_partkey AS t)) ELSE array(struct(true AS call, l_suppkey AS t)) END"
        lines = lines.selectExpr("l_orderkey", "l_linenumber", f"inline({both})").groupBy("l_orderkey", "call", "t").agg(F.min("l_linenumber").alias("line"))
        target = "CASE WHEN call THEN 'function:' ELSE 'constant:' END || CAST(t AS STRING)"

        orders = ord.select("o_orderkey", "o_custkey", "next_order").repartition(tasks_of(ord), "o_orderkey")
        pairs = "CASE WHEN next_order IS NULL THEN array(struct(false AS call, o_custkey AS t)) ELSE array(struct(false AS call, o_custkey AS t), struct(true AS call, next_order AS t)) END"
        orders = orders.selectExpr("o_orderkey", f"inline({pairs})").distinct()
        method, other = text("method", "o_orderkey"), text("struct", "t")

        least = item.groupBy("l_suppkey").agg(F.min("l_partkey").alias("p")).join(placed.select("s_suppkey").distinct(), F.col("l_suppkey") == F.col("s_suppkey"))
        owned = cust.select("c_custkey", "dir", "n_name", "c_mktsegment").distinct()
        found = [
            rows(lines, text("method", "l_orderkey"), target, "CASE WHEN call THEN 'calls' ELSE 'references' END", "line"),
            rows(orders, f"CASE WHEN call THEN {method} ELSE {other} END", f"CASE WHEN call THEN {text('method', 't')} ELSE {method} END",
                 "CASE WHEN call THEN 'calls' ELSE 'contains' END", "CASE WHEN call THEN 99 ELSE 1 END"),
            rows(placed.select("s_suppkey", "n_name").distinct(), text("function", "s_suppkey"), "'interface:' || n_name || ':BUILDING'", "'type_of'", "1"),
            rows(least, text("function", "l_suppkey"), text("constant", "p"), "'returns'", "2"),
            rows(owned.select("dir", "c_custkey").distinct(), "'file:' || dir || '/urgent.go'", text("struct", "c_custkey"), "'contains'", "1"),
            rows(owned.select("c_custkey", "n_name", "c_mktsegment").distinct(), text("struct", "c_custkey"), "'interface:' || n_name || ':' || c_mktsegment", "'implements'", "1"),
            rows(cust.select("n_name", "c_mktsegment", "r_name").distinct(), "'interface:' || n_name || ':' || c_mktsegment", "'interface:' || r_name", "'extends'", "1"),
        ]
        return schema.conform(reduce(DataFrame.union, found).withColumn("provenance", F.lit("ast")), schema.EDGES)

    return kept(spark, sf_dir, "edges", build)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before collapse, with the file of their source."""
    return _select(spark, sf_dir, "raw_edges")
