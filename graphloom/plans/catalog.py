"""Queries over the projected graph and the driver tables, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, paths, text
from ..operators import (
    expand, files, gather, lookup, rank, resolve, scoring, seeding, status, sync, synthesis, traverse,
)
from ..operators import detail as node_detail
from ..sources import projection as P
from ..sources.shared import written
from . import metrics

SUPPLIER = "Supplier#000000003"
QUERY = "BUILDING Customer urgent Supplier europe"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name, with its DuckDB text over the projected graph or the raw tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = P.oracle(sql) if graph else sql
        return f

    return add


def graph(spark, sf_dir):
    return P.nodes(spark, sf_dir), P.edges(spark, sf_dir)


# ---- lookup ---------------------------------------------------------------------------------------------------------

_TIER = "CASE WHEN {c} = '{t}' THEN 0 WHEN starts_with({c}, '{t}') THEN 1 WHEN contains({c}, '{t}') THEN 2 ELSE 3 END"


def _tier(term):
    return f"least({_TIER.format(c='name', t=term)}, {_TIER.format(c='qualified_name', t=term)})"


@query(f"""SELECT id, name, kind, qualified_name, tier FROM (SELECT *, {_tier('Supplier#00000000')} AS tier FROM nodes) WHERE tier < 3
ORDER BY tier, qualified_name, id LIMIT 1000""")
def query_lexical(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return lookup.query(nodes, "Supplier#00000000").select("id", "name", "kind", "qualified_name", "tier")


@query(f"""SELECT name, kind, file_path, start_line FROM (SELECT *, {_tier('urgent')} AS tier FROM nodes WHERE kind = 'method') WHERE tier < 3
ORDER BY tier, qualified_name, id LIMIT 50""")
def search_by_kind(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return lookup.search(nodes, "urgent", "method", 50)


@query("SELECT id, name, kind, file_path, start_line FROM nodes WHERE name = 'urgent' ORDER BY id LIMIT 1")
def resolve_symbol(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return lookup.resolve_symbol(nodes, "urgent").select("id", "name", "kind", "file_path", "start_line")


@query("""SELECT id, file_path, row_number() OVER (ORDER BY regexp_matches(file_path, '\\.pb\\.go$'), id)::INT AS pos FROM nodes WHERE name = 'BUILDING'""")
def node_definitions(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return lookup.definitions(nodes, "BUILDING").select("id", "file_path", "pos")


@query("""WITH d AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM nodes WHERE name = 'high'
), f AS (SELECT * FROM d WHERE contains(lower(file_path), 'asia/') OR NOT EXISTS (SELECT 1 FROM d WHERE contains(lower(file_path), 'asia/'))
), i AS (SELECT * FROM f WHERE start_line <= 40 AND end_line >= 40)
SELECT id, start_line, end_line FROM f WHERE id IN (SELECT id FROM i)
   OR (NOT EXISTS (SELECT 1 FROM i) AND id = (SELECT id FROM f ORDER BY abs(start_line - 40), pos LIMIT 1))""")
def node_narrowed(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return lookup.narrow(lookup.definitions(nodes, "high"), "asia/", 40).select("id", "start_line", "end_line")


@query("""SELECT id, name, file_path FROM nodes WHERE name = 'high' AND file_path = (SELECT min(file_path) FROM nodes WHERE kind = 'method' AND name = 'high')
ORDER BY id LIMIT 1""")
def node_in_file(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    path = nodes.filter("kind = 'method' AND name = 'high'").agg(F.min("file_path")).first()[0]
    return lookup.definition_in_file(nodes, "high", path).select("id", "name", "file_path")


# ---- traversal ------------------------------------------------------------------------------------------------------

_START = f"start AS (SELECT id, name FROM nodes WHERE name = '{SUPPLIER}' ORDER BY id LIMIT 1)"
_CALLS = "calls AS (SELECT source, target FROM edges WHERE kind = 'calls')"
_OWNERS = """owners AS (SELECT target AS method, source AS owner FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY strlen(source) DESC, source DESC) AS r FROM edges WHERE kind = 'contains') WHERE r = 1)"""


def _siblings(of: str) -> str:
    return f"""(SELECT DISTINCT f.id, m.id AS sibling FROM {of} f JOIN owners o ON o.method = f.id
  JOIN edges i ON i.kind = 'implements' AND i.source = o.owner JOIN edges j ON j.kind = 'implements' AND j.target = i.target AND j.source <> o.owner
  JOIN edges c ON c.kind = 'contains' AND c.source = j.source AND c.target <> f.id JOIN nodes m ON m.id = c.target AND m.name = f.name)"""


@query(f"""WITH s AS (SELECT id, name FROM nodes WHERE name = 'urgent' ORDER BY id LIMIT 1)
SELECT n.name, n.kind, n.file_path, n.start_line FROM s JOIN edges e ON e.kind = 'calls' AND e.source = s.id JOIN nodes n ON n.id = e.target
ORDER BY 3, 1, 4, 2 LIMIT 1000""")
def callees(spark, sf_dir) -> DataFrame:
    return traverse.callees(*graph(spark, sf_dir), "urgent")


@query(f"""WITH s AS (SELECT id, name FROM nodes WHERE name = 'urgent' ORDER BY id LIMIT 1), {_OWNERS},
t AS (SELECT id FROM s UNION SELECT sibling FROM {_siblings('s')})
SELECT n.name, n.kind, n.file_path, n.start_line FROM (SELECT DISTINCT e.source FROM edges e JOIN t ON e.kind = 'calls' AND e.target = t.id) c
JOIN nodes n ON n.id = c.source ORDER BY 3, 1, 4, 2 LIMIT 1000""")
def callers(spark, sf_dir) -> DataFrame:
    """With dispatch siblings."""
    return traverse.callers(*graph(spark, sf_dir), "urgent")


@query(f"""WITH {_START} SELECT n.name, n.kind, n.file_path, n.start_line FROM start s JOIN edges e ON e.kind = 'calls' AND e.target = s.id
JOIN nodes n ON n.id = e.source ORDER BY 3, 1, 4, 2 LIMIT 20""")
def callers_limited(spark, sf_dir) -> DataFrame:
    return traverse.callers(*graph(spark, sf_dir), SUPPLIER, 20)


@query(f"WITH {_OWNERS} SELECT method, owner FROM owners")
def method_owners(spark, sf_dir) -> DataFrame:
    return traverse.method_owners(P.edges(spark, sf_dir))


@query(f"""WITH {_OWNERS}, f AS (SELECT id, name FROM nodes WHERE kind = 'method' AND name = 'urgent')
SELECT id, sibling FROM {_siblings('f')}""")
def dispatch_siblings(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return traverse.dispatch_siblings(nodes.filter("kind = 'method' AND name = 'urgent'"), nodes, edges)


def _impact_sql(depth: int) -> str:
    parts = [_START, _CALLS, _OWNERS, "f0 AS (SELECT * FROM start)", "v0 AS (SELECT id FROM start)"]
    for d in range(1, depth + 1):
        parts.append(f"t{d} AS (SELECT id, id AS tid FROM f{d - 1} UNION ALL SELECT id, sibling FROM {_siblings(f'f{d - 1}')})")
        parts.append(f"l{d} AS (SELECT c.source FROM t{d} t JOIN calls c ON c.target = t.tid)")
        parts.append(f"f{d} AS (SELECT id, name FROM nodes WHERE id IN (SELECT source FROM l{d}) AND id NOT IN (SELECT id FROM v{d - 1}))")
        parts.append(f"v{d} AS (SELECT id FROM v{d - 1} UNION SELECT source FROM l{d})")
    inspected = " + ".join(f"(SELECT count(*) FROM l{d})" for d in range(1, depth + 1))
    return f"""WITH {', '.join(parts)}, a AS (SELECT n.* FROM nodes n WHERE id IN (SELECT id FROM v{depth}))
SELECT name, kind, file_path, start_line, count(*) OVER () AS node_count, ({inspected})::BIGINT AS edge_count FROM a"""


@query(_impact_sql(2))
def impact(spark, sf_dir) -> DataFrame:
    return traverse.impact(*graph(spark, sf_dir), SUPPLIER, 2)


def _affected_sql(depth: int) -> str:
    parts = [_CALLS, _OWNERS, "f0 AS (SELECT id, name FROM nodes WHERE file_path = 'europe/nation_3/high.go')", "v0 AS (SELECT id FROM f0)"]
    for d in range(1, depth + 1):
        parts.append(f"t{d} AS (SELECT id AS tid FROM f{d - 1} UNION SELECT sibling FROM {_siblings(f'f{d - 1}')})")
        parts.append(f"""r{d} AS (SELECT id, name, file_path, file_path LIKE '%\\_test.go' ESCAPE '\\' AS leaf FROM nodes WHERE id IN (
  SELECT source FROM calls JOIN t{d} ON target = tid) AND id NOT IN (SELECT id FROM v{d - 1}))""")
        parts.append(f"f{d} AS (SELECT id, name FROM r{d} WHERE NOT leaf)")
        parts.append(f"v{d} AS (SELECT id FROM v{d - 1} UNION SELECT id FROM r{d})")
    leaves = " UNION ".join(f"SELECT id FROM r{d} WHERE leaf" for d in range(1, depth + 1))
    return f"WITH {', '.join(parts)} SELECT name, kind, file_path, start_line FROM nodes WHERE id IN ({leaves})"


@query(_affected_sql(2))
def affected(spark, sf_dir) -> DataFrame:
    return traverse.affected(*graph(spark, sf_dir), ["europe/nation_3/high.go"], 2)


@query(_affected_sql(5))
def affected_whole(spark, sf_dir) -> DataFrame:
    """To the operator's own depth."""
    return traverse.affected(*graph(spark, sf_dir), ["europe/nation_3/high.go"])


@query("""WITH s AS (SELECT id FROM nodes WHERE name = 'urgent' ORDER BY id LIMIT 1), b AS (
  SELECT 'callees' AS side, target AS id FROM edges, s WHERE kind = 'calls' AND source = s.id
  UNION ALL SELECT 'callers', source FROM edges, s WHERE kind = 'calls' AND target = s.id)
SELECT side, string_agg(name, ', ' ORDER BY strlen(id), id) AS names, count(*) AS n FROM b JOIN nodes USING (id) GROUP BY side""")
def call_trail(spark, sf_dir) -> DataFrame:
    return traverse.call_trail(*graph(spark, sf_dir), "urgent")


@query("""WITH i AS (SELECT id FROM nodes WHERE kind = 'function')
SELECT i.id, count(e.source) AS callers, count(DISTINCT n.file_path) FILTER (WHERE n.file_path LIKE '%\\_test.go' ESCAPE '\\') AS n_test_files
FROM i LEFT JOIN edges e ON e.kind = 'calls' AND e.target = i.id LEFT JOIN nodes n ON n.id = e.source GROUP BY i.id""")
def blast_radius(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = traverse.blast_radius(nodes.filter("kind = 'function'"), nodes, edges)
    return found.select("id", "callers", F.size("test_files").cast("long").alias("n_test_files"))


# ---- files and status -----------------------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    """Counted by path and language first: a first text of a group makes tasks sort their rows."""
    n = P.nodes(spark, sf_dir).filter("file_path <> ''").groupBy(F.col("file_path").alias("path"), "language").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("path").agg(F.array_min(F.collect_set("language")).alias("language"), F.sum("n").alias("node_count"))


@query("""SELECT path, node_count FROM (SELECT file_path AS path, count(*) AS node_count FROM nodes GROUP BY 1)
WHERE starts_with(path, 'europe/') AND regexp_matches(path, '^europe/[^/]*/[hu][^/]*\\.go$') ORDER BY path LIMIT 1000""")
def files_filtered(spark, sf_dir) -> DataFrame:
    return files.files(_files(spark, sf_dir), "go", "europe", "europe/*/[hu]*.go", 3).select("path", "node_count")


@query("""WITH f AS (SELECT DISTINCT file_path AS path FROM nodes), p AS (SELECT path, string_split(path, '/') AS p FROM f), e AS (
  SELECT array_to_string(p[1:k], '/') AS parent, p[k + 1] AS name, k < len(p) - 1 AS is_dir FROM p, LATERAL (SELECT unnest(range(len(p))) AS k))
SELECT parent, name, is_dir, count(*) AS n_files FROM e GROUP BY ALL""")
def file_tree(spark, sf_dir) -> DataFrame:
    return files.tree(_files(spark, sf_dir))


@query("""SELECT 'nodes_by_kind' AS section, kind AS key, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'edges_by_kind', k, count(kind) FROM (SELECT unnest(['calls', 'references', 'extends', 'implements', 'overrides', 'instantiates', 'returns', 'type_of', 'imports', 'contains']) AS k) LEFT JOIN edges ON kind = k GROUP BY k
UNION ALL SELECT 'files_by_language', 'go', count(DISTINCT file_path) FROM nodes
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM nodes""")
def status_counts(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return status.status(nodes, edges, _files(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END AS text FROM documents), p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM d)
SELECT doc_id, k::INT AS line, p[k] AS text FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS k)""", graph=False)
def source_numbered(spark, sf_dir) -> DataFrame:
    """Every document as a numbered source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return files.lines(docs).withColumnRenamed("path", "doc_id")


@query("""WITH RECURSIVE d AS (SELECT source AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS pos, strlen(text) AS b FROM documents
), f AS (
  SELECT name, 1 AS pos, true AS shown, b AS used, 1 AS n, 0 AS over FROM d WHERE pos = 1
  UNION ALL SELECT d.name, d.pos, f.n < 16 AND f.used + b <= 12000, f.used + CASE WHEN f.n < 16 AND f.used + b <= 12000 THEN b ELSE 0 END,
    f.n + (f.n < 16 AND f.used + b <= 12000)::INT, f.over + (NOT (f.n < 16 AND f.used + b <= 12000))::INT FROM f JOIN d ON d.name = f.name AND d.pos = f.pos + 1)
SELECT name, pos, shown, NOT shown AND over <= 20 AS listed FROM f""", graph=False)
def definition_budget(spark, sf_dir) -> DataFrame:
    """Which bodies fit, with sources as symbols and documents as their definitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    sized = docs.select(F.col("source").alias("name"), place.alias("pos"), F.octet_length("text").cast("long").alias("body_bytes"))
    return node_detail.within_budget(sized)


# ---- tokenizers and predicates --------------------------------------------------------------------------------------

_B = "\\b({})\\b"


def _all(shape: str, of: str = "text") -> str:
    return f"regexp_extract_all({of}, '{_B.format(shape)}', 1)"


_COMMON = "[" + ", ".join(f"'{w}'" for w in sorted(text.COMMON_WORDS)) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS)) + "]"
_DOTTED = f"list_filter(flatten(list_transform({_all(text.DOTTED)}, lambda d: list_prepend(d, string_split(d, '.')))), lambda p: len(p) >= 2)"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat({_all(text.CAMEL)}, {_all(text.SNAKE)}, {_all(text.SCREAMING)},
  {_all(text.ACRONYM)}, {_DOTTED}, {_all(text.LOWER)}), lambda t: NOT list_contains({_COMMON}, lower(t))))), ' ') AS tokens FROM documents""", graph=False)
def symbol_tokens(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(F.array_sort(text.symbol_tokens_column(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS split FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter(list_transform(list_concat({_all(text.COMPOUND)}, {_all(text.SNAKE)}), lambda t: lower(t)), lambda t: len(t) >= 3),
  list_filter(list_transform(regexp_extract_all(split, '[a-zA-Z0-9]+'), lambda t: lower(t)), lambda t: len(t) >= 3 AND NOT list_contains({_STOP}, t))))), ' ') AS terms
FROM d""", graph=False)
def search_terms(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(F.array_sort(text.search_terms_column(F.col("text"))), " ").alias("terms"))


@query("""WITH w AS (SELECT DISTINCT lower(p_name) AS t FROM part UNION SELECT DISTINCT lower(o_orderpriority) FROM orders UNION
  SELECT unnest(['queries', 'boxes', 'running', 'handled', 'classes', 'pass', 'ties', 'files', 'used', 'sing', 'gas', 'x']))
SELECT t, CASE WHEN t LIKE '%ies' AND strlen(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%es' AND strlen(t) > 4 THEN t[:-3]
  WHEN t LIKE '%ing' AND strlen(t) > 5 THEN t[:-4] WHEN t LIKE '%ed' AND strlen(t) > 4 THEN t[:-3]
  WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND strlen(t) > 3 THEN t[:-2] ELSE t END AS stem FROM w""", graph=False)
def stems(spark, sf_dir) -> DataFrame:
    words = ["queries", "boxes", "running", "handled", "classes", "pass", "ties", "files", "used", "sing", "gas", "x"]
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("t"))
    t = t.union(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lower("o_orderpriority")))
    t = t.union(spark.createDataFrame([(w,) for w in words], "t string")).distinct()
    return t.select("t", text.stem_column(F.col("t")).alias("stem"))


_ODD = "['src/testing/a.go', 'src/aTestdir/b.go', 'test_a.py', 'x/FooTest.java', 'x/icons/a.ts', 'locale_en.json', 'a/b.pb.go', 'mock_a.go', 'a/mock_a.go', 'x.min.js', 'a/b.go']"


@query(f"""WITH p AS (SELECT DISTINCT file_path AS p FROM nodes UNION SELECT unnest({_ODD}))
SELECT p AS path, regexp_matches(b, '^test_|_test\\.|\\.test\\.|-spec\\.') OR regexp_matches(b, '(Test|Tests|TestCase|Spec)\\.[^./]+$') OR contains(d, 'Test')
  OR regexp_matches('/' || lower(d) || '/', '/(test|tests|__tests__|spec|specs|testlib|testing|integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') AS is_test,
  regexp_matches(b, '(?i)^(icons?|i18n|l10n|locales?|translations?)[._-]') OR regexp_matches('/' || lower(d) || '/', '/(icons?|i18n|l10n|locales?|translations?)/') AS is_icon,
  regexp_matches(p, '{"|".join(paths.GENERATED)}') AS is_generated, d AS dir, len(p) - len(replace(p, '/', '')) AS depth
FROM (SELECT p, regexp_extract(p, '[^/]*$') AS b, regexp_extract(p, '^(.*)/[^/]*$', 1) AS d FROM p)""")
def path_predicates(spark, sf_dir) -> DataFrame:
    odd = [x.strip(" '") for x in _ODD[1:-1].split(",")]
    p = P.nodes(spark, sf_dir).select(F.col("file_path").alias("path")).union(spark.createDataFrame([(x,) for x in odd], "path string")).distinct()
    c = F.col("path")
    return p.select(
        "path", paths.is_test_path(c).alias("is_test"), paths.is_icon_path(c).alias("is_icon"), paths.is_generated(c).alias("is_generated"),
        paths.file_dir(c).alias("dir"), paths.depth(c).cast("long").alias("depth"),
    )


def _seg(x):
    return (
        f"(CASE WHEN strlen({x}) < 128 THEN unhex(printf('%02X', strlen({x}))) "
        f"ELSE unhex(printf('%02X%02X', strlen({x}) % 128 + 128, strlen({x}) // 128)) END || encode({x}))"
    )


@query(f"""SELECT id, kind || ':' || substr(sha256({_seg('kind')} || {_seg('qualified_name')} || {_seg('file_path')}), 1, 32) AS node_id FROM nodes""")
def node_ids(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return nodes.select("id", hashing.node_id(F.col("kind"), F.col("qualified_name"), F.col("file_path")).alias("node_id"))


@query("""SELECT doc_id, sha256(text) AS content_hash, text ~ '[_]' OR (length(text) >= 6 AND regexp_matches(text, '(?s)^.+[A-Z]')) AS has_inner FROM documents""", graph=False)
def content_hashes(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", hashing.content_hash(F.col("text").cast("binary")).alias("content_hash"), text.is_distinctive(F.col("text")).alias("has_inner"))


# ---- exploration ----------------------------------------------------------------------------------------------------

_SYM = ["BUILDING", "Customer", "Supplier", "urgent", "supplier", "europe"]


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_EXACT = f"""exact AS (SELECT id, name, kind, qualified_name, file_path, 10.0 + CASE WHEN file_path <> '' THEN 20.0 * (d - 1) ELSE 0 END AS score FROM (
  SELECT n.*, d FROM nodes n JOIN (SELECT file_path, count(DISTINCT name) AS d FROM nodes WHERE name IN ({_list(text.symbol_tokens(QUERY))}) GROUP BY 1) USING (file_path)
  WHERE name IN ({_list(text.symbol_tokens(QUERY))})) ORDER BY score DESC, id LIMIT 16)"""


def _prefix_sql() -> str:
    prefixes = list(dict.fromkeys(text.titlecase(s) for s in text.symbol_tokens(QUERY)))
    size = "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN {len(p)}" for p in prefixes) + " END"
    return f"""prefix AS (SELECT id, name, kind, qualified_name, file_path, 15.0 + greatest(10.0 - (strlen(name) - p) / 3.0, 0.0) AS score
  FROM (SELECT *, {size} AS p FROM nodes WHERE kind IN ('struct', 'interface', 'type_alias')) WHERE p IS NOT NULL)"""


def _hits_sql(columns: list[str], terms: list[str]) -> str:
    return " + ".join("(" + " OR ".join(f"contains({c}, '{t}')" for c in columns) + ")::INT" for t in terms)


_TERMS = text.search_terms(QUERY)
_TEXT = f"""words AS (SELECT id, name, kind, qualified_name, file_path, 10.0 + 5.0 * (h - 1) AS score FROM (
  SELECT *, {_hits_sql(['lower(name)', 'lower(qualified_name)'], _TERMS)} AS h FROM nodes WHERE kind <> 'import') WHERE h > 0)"""
_MERGED = f"""{_EXACT}, {_prefix_sql()}, {_TEXT}, merged AS (SELECT id, any_value(name) AS name, any_value(kind) AS kind, any_value(file_path) AS file_path,
  max(score) AS score, string_agg(DISTINCT ch, ',' ORDER BY ch) AS channels FROM (SELECT *, 'exact' AS ch FROM exact UNION ALL SELECT *, 'prefix' FROM prefix UNION ALL SELECT *, 'text' FROM words) GROUP BY id)"""


@query(f"WITH {_EXACT} SELECT id, score::DOUBLE AS score FROM exact")
def gather_exact(spark, sf_dir) -> DataFrame:
    return gather.by_exact_name(P.nodes(spark, sf_dir), text.symbol_tokens(QUERY)).select("id", "score")


@query(f"WITH {_prefix_sql()} SELECT id, round(score, 9)::DOUBLE AS score FROM prefix")
def gather_prefix(spark, sf_dir) -> DataFrame:
    return gather.by_title_prefix(P.nodes(spark, sf_dir), text.symbol_tokens(QUERY)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_TEXT} SELECT id, score::DOUBLE AS score FROM words")
def gather_text(spark, sf_dir) -> DataFrame:
    return gather.by_text(P.nodes(spark, sf_dir), _TERMS).select("id", "score")


_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_GROUPS = " + ".join(
    "(" + " OR ".join(f"contains(lower(name), '{t}') OR contains(lower({_DIR}), '{t}')" for t in g) + ")::INT" for g in text.stem_groups(_TERMS)
)
_DISTINCT = f"(lower(name) IN ({_list(_TERMS)}) AND length(name) >= 6 AND (contains(name, '_') OR regexp_matches(name, '^.+[A-Z]')))"
_RERANKED = f"""{_MERGED}, damp AS (SELECT * REPLACE (CASE WHEN contains(regexp_extract(file_path, '[^/]*$'), '_test.') AND NOT {_DISTINCT} THEN score * 0.3 ELSE score END AS score) FROM merged
), top AS (SELECT file_path AS f, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, file_path) AS r FROM damp WHERE file_path <> '' GROUP BY 1
), core AS (SELECT regexp_extract(max(f) FILTER (WHERE r = 1), '^(.*)/[^/]*$', 1) AS d, max(n) FILTER (WHERE r = 1) >= 3 * coalesce(max(n) FILTER (WHERE r = 2), 0) AS ok FROM top
), boost AS (SELECT damp.* REPLACE (CASE WHEN ok AND file_path <> '' AND ({_DIR} = d OR starts_with({_DIR}, d || '/')) THEN score + 25 ELSE score END AS score) FROM damp, core
), reranked AS (SELECT * REPLACE (score * CASE WHEN {_GROUPS} >= 2 THEN 1 + 0.5 * ({_GROUPS}) ELSE 1 END AS score) FROM boost)"""


@query(f"WITH {_RERANKED} SELECT id, round(score, 6)::DOUBLE AS score, channels FROM reranked")
def gather_ranked(spark, sf_dir) -> DataFrame:
    found = gather.gather(P.nodes(spark, sf_dir), QUERY)
    return found.select("id", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


@query("""WITH RECURSIVE up AS (SELECT source AS a, target AS b FROM edges WHERE kind IN ('extends', 'implements')
), c AS (SELECT a AS root, b AS id, 1 AS depth FROM up WHERE a LIKE 'struct:%' UNION SELECT root, b, depth + 1 FROM c JOIN up ON id = a WHERE depth < 8)
SELECT root, id, min(depth)::INT AS depth FROM c GROUP BY root, id""")
def hierarchy_closure(spark, sf_dir) -> DataFrame:
    edges = P.edges(spark, sf_dir)
    up = edges.filter("kind IN ('extends', 'implements')").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return expand.closure(up.filter("a LIKE 'struct:%'").select(F.col("a").alias("root")), up)


@query("""WITH RECURSIVE up AS (SELECT source AS a, target AS b FROM edges WHERE kind IN ('extends', 'implements')
), focal AS (SELECT id AS root FROM nodes WHERE id IN ('struct:7', 'struct:11', 'interface:EUROPE')
), p AS (SELECT root, b AS id, 1 AS depth FROM up JOIN focal ON a = root UNION SELECT root, b, depth + 1 FROM p JOIN up ON id = a WHERE depth < 6
), q AS (SELECT root, a AS id, 1 AS depth FROM up JOIN focal ON b = root UNION SELECT root, a, depth + 1 FROM q JOIN up ON id = b WHERE depth < 6
), w AS (SELECT id, min((root, way, depth)) AS o FROM (SELECT *, 0 AS way FROM p UNION ALL SELECT *, 1 FROM q) WHERE id NOT IN (SELECT root FROM focal) GROUP BY id
), first AS (SELECT id FROM w ORDER BY o, id LIMIT 50
), sib AS (SELECT up.a AS id, min(up.b) AS parent FROM up WHERE up.b IN (SELECT id FROM p) AND up.a NOT IN (SELECT id FROM first) AND up.a NOT IN (SELECT root FROM focal) GROUP BY up.a
), more AS (SELECT id, row_number() OVER (ORDER BY parent, id) AS r FROM sib)
SELECT id FROM first UNION SELECT id FROM more WHERE r <= 50 - (SELECT count(*) FROM first)""")
def type_hierarchy(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    focal = nodes.filter(F.col("id").isin("struct:7", "struct:11", "interface:EUROPE"))
    return expand.ids_frame(spark, expand.type_hierarchy(nodes, edges, focal)).select("id")


def _bfs_sql() -> str:
    parts = [
        "links AS (SELECT source AS a, target AS b FROM edges WHERE source <> target AND kind <> 'contains' UNION ALL SELECT target, source FROM edges WHERE source <> target AND kind <> 'contains')",
        "o0 AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM nodes WHERE id IN ('function:3', 'struct:7', 'method:33'))",
        "s0 AS (SELECT id FROM o0)",
    ]
    for d in (1, 2, 3):
        parts.append(
            f"""o{d} AS (SELECT id, row_number() OVER (ORDER BY pos, id) AS pos FROM (SELECT b AS id, min(pos) AS pos FROM o{d - 1} JOIN links ON a = o{d - 1}.id
  WHERE b NOT IN (SELECT id FROM s{d - 1}) AND b IN (SELECT id FROM nodes) GROUP BY b ORDER BY pos, id LIMIT (SELECT 200 - count(*) FROM s{d - 1})))"""
        )
        parts.append(f"s{d} AS (SELECT id FROM s{d - 1} UNION SELECT id FROM o{d})")
    return f"WITH {', '.join(parts)} SELECT id FROM s3"


@query(_bfs_sql())
def bounded_bfs(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    roots = nodes.filter(F.col("id").isin("function:3", "struct:7", "method:33")).withColumn("score", F.lit(1.0))
    reached, _ = expand.bounded_bfs(nodes, edges, roots)
    return expand.ids_frame(spark, reached).select("id")


@query("""WITH roots AS (SELECT unnest(['function:3', 'method:33']) AS id), near AS (
  SELECT source AS id FROM edges JOIN roots ON target = id WHERE kind = 'calls' UNION SELECT target FROM edges JOIN roots ON source = id WHERE kind = 'calls')
SELECT id FROM near JOIN nodes USING (id) WHERE id NOT IN (SELECT id FROM roots)
  AND file_path IN (SELECT file_path FROM nodes WHERE id IN ('function:3', 'method:33', 'function:1', 'function:5', 'struct:7')) ORDER BY id LIMIT 60""")
def glue_nodes(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    found = expand.glue_nodes(nodes, edges, ["function:3", "method:33"], ["function:3", "method:33", "function:1", "function:5", "struct:7"])
    return expand.ids_frame(spark, found).select("id")


_SEED = "urgent high Supplier#000000003 BUILDING EUROPE low_test"


@query(f"""WITH d AS (SELECT name AS token, id, start_line, end_line, count(*) OVER (PARTITION BY name) AS n, min(id) OVER (PARTITION BY name) AS first
  FROM nodes WHERE name IN ({_list(seeding.seed_tokens(_SEED))})
), c AS (SELECT d.*, (SELECT count(*) FROM edges WHERE kind = 'calls' AND target = d.id) AS callers FROM d WHERE n <= 3
), few AS (SELECT token, id, id = first OR callers >= 0.25 * max(callers) OVER (PARTITION BY token) AS is_primary FROM c
), many AS (SELECT token, arg_min(id, (-greatest(0, end_line - start_line + 1), id)) AS id FROM d WHERE n > 3 GROUP BY token)
SELECT * FROM few UNION ALL SELECT token, id, true FROM many""")
def named_seeds(spark, sf_dir) -> DataFrame:
    return seeding.named_seeds(*graph(spark, sf_dir), _SEED)


def _walk_sql(rounds: int) -> str:
    parts = [
        "n AS (SELECT id FROM nodes WHERE kind IN ('function', 'interface', 'struct'))",
        "l AS (SELECT source AS a, target AS b FROM edges WHERE kind NOT IN ('contains') AND source <> target AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)",
        "d AS (SELECT a, count(*) AS d FROM both_ways GROUP BY a)",
        "base AS MATERIALIZED (SELECT n.id, (n.id IN ('function:3', 'struct:7'))::INT / 2.0::DOUBLE AS r, d.d FROM n LEFT JOIN d ON d.a = n.id)",
        "m0 AS MATERIALIZED (SELECT id, r AS m FROM base)",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"""m{k} AS MATERIALIZED (SELECT base.id, 0.75 * (coalesce(x.s, 0) + CASE WHEN base.d IS NULL THEN p.m ELSE 0 END) + 0.25 * base.r AS m FROM base JOIN m{k - 1} p USING (id)
  LEFT JOIN (SELECT b, sum(m / d) AS s FROM m{k - 1} q JOIN both_ways ON a = q.id JOIN d ON d.a = both_ways.a GROUP BY b) x ON x.b = base.id)"""
        )
    return f"WITH {', '.join(parts)} SELECT id, round(floor(m * 1e9 + 0.5) / 1e9, 7)::DOUBLE AS score FROM m{rounds}"


@query(_walk_sql(25))
def random_walk(spark, sf_dir) -> DataFrame:
    """The distributed form."""
    nodes, edges = graph(spark, sf_dir)
    ids = written(nodes.filter("kind IN ('function', 'interface', 'struct')").select("id"))
    seeds = ids.filter(F.col("id").isin("function:3", "struct:7"))
    return rank.walk_distributed(ids, expand.rank_edges(edges), seeds).select("id", F.round("score", 7).alias("score"))


@query()
def random_walk_whole(spark, sf_dir) -> DataFrame:
    """The distributed form over all nodes and ranked edges; tests compare it with the bounded kernel."""
    nodes, edges = graph(spark, sf_dir)
    ids = written(nodes.select("id"))
    seeds = ids.filter(F.col("id").isin("function:3", "struct:7"))
    return rank.walk_distributed(ids, expand.rank_edges(edges), seeds).select("id", F.round("score", 7).alias("score"))


@query("""WITH e AS (SELECT unnest(['function:3', 'struct:7']) AS id), named AS (SELECT 'interface:EUROPE' AS id), b AS (SELECT * FROM e UNION SELECT * FROM named
), r AS (SELECT source, target FROM edges WHERE kind <> 'contains'), c AS (SELECT target AS id FROM r JOIN b ON source = id UNION SELECT source FROM r JOIN b ON target = id)
SELECT file_path, max(CASE WHEN id IN (SELECT id FROM named) THEN 50.0 WHEN id IN (SELECT id FROM e) THEN 10.0 WHEN id IN (SELECT id FROM c) THEN 3.0 ELSE 1.0 END)::DOUBLE AS score
FROM nodes WHERE file_path <> '' GROUP BY file_path HAVING score >= 3""")
def file_tiers(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    one = lambda *ids: spark.createDataFrame([(x,) for x in ids], "id string")
    return scoring.file_tiers(nodes, edges, one("interface:EUROPE"), one("function:3", "struct:7"))


@query(f"""SELECT file_path, {' + '.join(f"max((contains(lower(name), '{t}') OR contains(lower(qualified_name), '{t}'))::INT)" for t in _TERMS)} AS hits
FROM nodes WHERE file_path <> '' GROUP BY file_path""")
def file_hits(spark, sf_dir) -> DataFrame:
    return scoring.file_hits(P.nodes(spark, sf_dir), _TERMS)


@query()
def explore(spark, sf_dir) -> DataFrame:
    from ..operators import explore as module

    nodes, edges = graph(spark, sf_dir)
    return module.explore(nodes, edges, QUERY).symbols.select("file_path", "position", "id", "score", "rank", "callers")


# ---- resolution and synthesis ---------------------------------------------------------------------------------------

_MODULE = "regexp_replace({}, '/[^/]*$', '')"
_REFS = f""", refs AS (
  SELECT path AS file, {_MODULE.format('path')} AS module_key, 'method:' || CAST(l_orderkey AS STRING) AS from_id, s_name AS name,
         CASE WHEN g.dir = {_MODULE.format('path')} THEN '' ELSE 'p' || CAST(s_nationkey AS STRING) END AS pkg_alias,
         CASE WHEN l_linenumber % 2 = 0 THEN 'references' ELSE 'calls' END AS kind, l_linenumber AS line
  FROM {{lineitem}} JOIN ord ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN geo g ON s_nationkey = g.n_nationkey
  UNION ALL SELECT path, {_MODULE.format('path')}, 'method:' || CAST(o_orderkey AS STRING), c_name, '', CASE WHEN o_orderkey % 3 = 0 THEN 'contains' ELSE 'instantiates' END, 7 FROM ord
  UNION ALL SELECT path, {_MODULE.format('path')}, 'method:' || CAST(o_orderkey AS STRING), c_mktsegment, '', CASE WHEN o_orderkey % 2 = 0 THEN 'embeds' ELSE 'instantiates' END, 8 FROM ord
  UNION ALL SELECT path, {_MODULE.format('path')}, 'method:' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN 'fmt' ELSE 'world/' || {_MODULE.format('path')} END, '', 'imports', 9 FROM ord
), imports AS (
  SELECT DISTINCT f.file, 'p' || CAST(n_nationkey AS STRING) AS alias, dir AS target_module FROM (SELECT DISTINCT file FROM refs) f, geo
  WHERE (n_nationkey + length(f.file)) % 3 <> 0
)"""


def _pass1(spark, sf_dir):
    """refs and imports of the SQL: line items meet their order where they are dealt by it, all else is a scan of the orders."""
    ord, geo, item = P.ords(spark, sf_dir), P.geo(spark, sf_dir), P.table(spark, sf_dir, "lineitem")
    ord = ord.withColumn("module_key", F.regexp_replace("path", "/[^/]*$", ""))
    names = ("file", "module_key", "from_id", "name", "pkg_alias", "kind", "line")
    rows = lambda df, *sql: df.selectExpr(*(f"{x} AS {n}" for x, n in zip(sql, names, strict=True)))
    n = P.tasks_of(item)
    lines = item.select("l_orderkey", "l_suppkey", "l_linenumber").repartition(n, "l_orderkey").join(
        ord.select("o_orderkey", "path", "module_key").repartition(n, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    placed = P.table(spark, sf_dir, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "s_nationkey", "dir")
    lines = lines.join(placed, F.col("l_suppkey") == F.col("s_suppkey"))
    by = "'method:' || CAST(o_orderkey AS STRING)"
    refs = rows(lines, "path", "module_key", "'method:' || CAST(l_orderkey AS STRING)", "s_name", "CASE WHEN dir = module_key THEN '' ELSE 'p' || CAST(s_nationkey AS STRING) END",
                "CASE WHEN l_linenumber % 2 = 0 THEN 'references' ELSE 'calls' END", "l_linenumber")
    for name, kind, line in (
        ("c_name", "CASE WHEN o_orderkey % 3 = 0 THEN 'contains' ELSE 'instantiates' END", 7),
        ("c_mktsegment", "CASE WHEN o_orderkey % 2 = 0 THEN 'embeds' ELSE 'instantiates' END", 8),
        ("CASE WHEN o_orderkey % 4 = 0 THEN 'fmt' ELSE 'world/' || module_key END", "'imports'", 9),
    ):
        refs = refs.union(rows(ord, "path", "module_key", by, name, "''", kind, str(line)))
    files = ord.select(F.col("path").alias("file")).distinct().crossJoin(geo.select("n_nationkey", "dir"))
    imports = files.filter((F.col("n_nationkey") + F.length("file")) % 3 != 0)
    imports = imports.select("file", F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("dir").alias("target_module")).distinct()
    return P.kept(spark, sf_dir, "refs", lambda: refs.withColumn("col", F.lit(0))), P.kept(spark, sf_dir, "imports", lambda: imports)


def _modules(nodes):
    """Written, a row a file: small enough for Spark to send it to where the nodes are."""
    return written(nodes.select("file_path").distinct().select("file_path", F.regexp_replace("file_path", "/[^/]*$", "").alias("module_key")))


_INDEX = f"""idx AS (SELECT {_MODULE.format('file_path')} AS module_key, name, min(id) AS target, count(DISTINCT id) - 1 AS collisions FROM nodes WHERE kind <> 'file' GROUP BY 1, 2)"""
_RESOLVED = f"""{_INDEX}, res AS (SELECT r.*, x.target FROM refs r LEFT JOIN imports i ON i.file = r.file AND i.alias = r.pkg_alias
  LEFT JOIN idx x ON x.module_key = CASE WHEN r.pkg_alias = '' THEN r.module_key ELSE i.target_module END AND x.name = r.name)"""


def _refs_oracle(sql: str) -> str:
    names = {t: t for t in P.TABLES}
    return f"WITH {(P.CTES + _REFS).format(**names)}, {sql}"


@query(f"WITH {_INDEX} SELECT module_key, name, target, collisions FROM idx")
def symbol_index(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return resolve.symbol_index(nodes, _modules(nodes))


def resolve_names(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    refs, imports = _pass1(spark, sf_dir)
    index = resolve.symbol_index(nodes, _modules(nodes))
    return resolve.resolve_names(refs, imports, index).select("from_id", "name", "pkg_alias", "kind", "line", "target")


QUERIES["resolve_names"] = resolve_names
ORACLES["resolve_names"] = _refs_oracle(f"{_RESOLVED} SELECT from_id, name, pkg_alias, kind, line, target FROM res")


def reference_edges(spark, sf_dir) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    refs, imports = _pass1(spark, sf_dir)
    resolved = resolve.resolve_names(refs, imports, resolve.symbol_index(nodes, _modules(nodes)))
    found = resolve.reference_edges(resolved, nodes.select("id", "kind"), "world")
    package = hashing.node_id(F.lit("package"), F.col("name"), F.col("name"))
    target = F.when(F.col("target") == package, F.concat(F.lit("package:"), F.col("name"))).otherwise(F.col("target"))
    return found.select("source", target.alias("target"), "kind", "provenance", F.col("by").alias("synthesized_by"), "state")


QUERIES["reference_edges"] = reference_edges
ORACLES["reference_edges"] = _refs_oracle(f"""{_RESOLVED}, k AS (SELECT r.*, t.kind AS tk, s.kind AS sk FROM res r LEFT JOIN nodes t ON t.id = r.target LEFT JOIN nodes s ON s.id = r.from_id
), m AS (SELECT *, CASE WHEN kind <> 'embeds' THEN kind WHEN tk = 'interface' AND sk IS DISTINCT FROM 'interface' THEN 'implements' WHEN tk IS DISTINCT FROM 'interface' THEN 'extends' ELSE 'embeds' END AS made FROM k)
SELECT CASE WHEN kind = 'contains' THEN target ELSE from_id END AS source,
  CASE WHEN kind = 'contains' THEN from_id WHEN kind = 'imports' THEN 'package:' || name ELSE target END AS target, made AS kind,
  CASE WHEN made IN ('implements', 'extends') THEN 'heuristic' ELSE 'ast' END AS provenance,
  CASE WHEN made IN ('implements', 'extends') THEN 'declared-' || made ELSE '' END AS synthesized_by,
  CASE WHEN kind = 'imports' THEN CASE WHEN name = 'world' OR starts_with(name, 'world/') THEN 'edge' ELSE 'external' END
       WHEN target IS NULL AND kind = 'calls' THEN 'pending' WHEN target IS NULL THEN 'unresolved'
       WHEN kind = 'instantiates' AND tk IS DISTINCT FROM 'struct' THEN 'unresolved' ELSE 'edge' END AS state
FROM m""")


@query("""SELECT source, target, kind, line FROM (SELECT *, row_number() OVER (PARTITION BY source, kind, target ORDER BY path, line) AS r FROM raw_edges) WHERE r = 1""")
def collapse_edges(spark, sf_dir) -> DataFrame:
    raw = P.raw_edges(spark, sf_dir).withColumn("col", F.lit(0)).select("source", "target", "kind", "line", "col")
    return resolve.collapse(raw, P.nodes(spark, sf_dir)).drop("col")


@query("""WITH have AS (SELECT DISTINCT source, name FROM edges JOIN nodes ON target = id WHERE edges.kind = 'contains' AND nodes.kind = 'method'
), spec AS (SELECT i.id AS iface, m.name FROM nodes i, (SELECT DISTINCT name FROM nodes WHERE kind = 'method') m WHERE i.kind = 'interface' AND (length(i.id) + length(m.name)) % 3 = 0
), need AS (SELECT iface, count(*) AS n FROM spec GROUP BY iface)
SELECT source, spec.iface AS target FROM have JOIN spec USING (name) JOIN need USING (iface) GROUP BY source, spec.iface, n HAVING count(*) = n""")
def structural_implements(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    names = nodes.filter("kind = 'method'").select("name").distinct()
    spec = nodes.filter("kind = 'interface'").select(F.col("id").alias("iface_id")).crossJoin(F.broadcast(names))  # five names
    spec = spec.filter((F.length("iface_id") + F.length("name")) % 3 == 0).withColumn("arity", F.lit(0))
    arity = nodes.filter("kind = 'method'").select(F.col("id").alias("method_id"), F.lit(0).alias("arity"))
    return synthesis.structural_implements(edges, nodes, spec, arity).select("source", "target")


_KIN = """kin AS (SELECT 'struct:' || c_custkey AS a, 'struct:' || (c_custkey // 2) AS b FROM customer WHERE c_custkey // 2 <> c_custkey AND c_custkey // 2 > 0)"""


def _kin(spark, sf_dir):
    """Structs extend the struct of half their number; methods from the projection."""
    nodes, edges = graph(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("c_custkey").alias("k"), F.expr("c_custkey div 2").alias("h"))
    kin = c.filter("h <> k AND h > 0").select(F.concat(F.lit("struct:"), "k").alias("source"), F.concat(F.lit("struct:"), "h").alias("target"))
    kin = kin.withColumns({"kind": F.lit("extends"), "line": F.lit(1), "col": F.lit(0)})
    contains = edges.filter("kind = 'contains' AND source LIKE 'struct:%'").select("source", "target", "kind", "line", "col")
    return nodes, written(kin.unionByName(contains))


@query(f"""WITH RECURSIVE {_KIN}, up AS (SELECT a AS type, b AS super, 1 AS depth FROM kin UNION ALL SELECT type, b, depth + 1 FROM up JOIN kin ON super = a
), own AS (SELECT source AS type, target AS method, name FROM edges JOIN nodes ON target = id WHERE edges.kind = 'contains' AND source LIKE 'struct:%')
SELECT o.method AS source, arg_min(s.method, (depth, s.method)) AS target FROM own o JOIN up USING (type) JOIN own s ON s.type = super AND s.name = o.name GROUP BY o.method""")
def overrides(spark, sf_dir) -> DataFrame:
    nodes, edges = _kin(spark, sf_dir)
    arity = nodes.select(F.col("id").alias("method_id"), F.lit(0).alias("arity"))
    return synthesis.overrides(edges, nodes, arity).select("source", "target")


@query(f"""WITH RECURSIVE {_KIN}, up AS (SELECT a AS type, b AS super, 1 AS depth FROM kin UNION ALL SELECT type, b, depth + 1 FROM up JOIN kin ON super = a
), own AS (SELECT source AS type, target AS method, name FROM edges JOIN nodes ON target = id WHERE edges.kind = 'contains' AND source LIKE 'struct:%'
), ask AS (SELECT DISTINCT method AS from_id, type, 'low_test' AS name FROM own WHERE name = 'urgent')
SELECT from_id, arg_min(s.method, (depth, s.method)) AS target FROM ask LEFT JOIN up USING (type) LEFT JOIN own s ON s.type = super AND s.name = ask.name GROUP BY from_id""")
def retried_calls(spark, sf_dir) -> DataFrame:
    nodes, edges = _kin(spark, sf_dir)
    pending = nodes.filter("kind = 'method' AND name = 'urgent'").select(F.col("id").alias("from_id"), F.lit("low_test").alias("name"), F.lit(None).cast("string").alias("target"))
    return synthesis.retry_calls(pending, edges, nodes).select("from_id", "target")


# ---- sync -----------------------------------------------------------------------------------------------------------


def sync_stale(spark, sf_dir) -> DataFrame:
    """Files whose references are looked up anew when one file changes."""
    nodes, _ = graph(spark, sf_dir)
    refs, imports = _pass1(spark, sf_dir)
    changed = spark.createDataFrame([("europe/nation_3/high.go",)], "path string")
    declared = nodes.filter("file_path = 'europe/nation_3/high.go'").join(_modules(nodes), "file_path")
    return sync.stale_files(resolve.lookups(refs, imports), declared, changed)


QUERIES["sync_stale"] = sync_stale
ORACLES["sync_stale"] = _refs_oracle(f"""d AS (SELECT DISTINCT name, {_MODULE.format('file_path')} AS module_key FROM nodes WHERE file_path = 'europe/nation_3/high.go'
), l AS (SELECT r.file, r.name, CASE WHEN r.pkg_alias = '' THEN r.module_key ELSE i.target_module END AS module_key
  FROM refs r LEFT JOIN imports i ON i.file = r.file AND i.alias = r.pkg_alias)
SELECT file FROM l JOIN d USING (module_key, name) UNION SELECT 'europe/nation_3/high.go'""")


def sync_resolved(spark, sf_dir) -> DataFrame:
    """Outcomes after a change: those of stale files are looked up anew, in an index without the names of one file, the others are kept."""
    nodes, _ = graph(spark, sf_dir)
    refs, imports = _pass1(spark, sf_dir)
    gone = "europe/nation_3/high.go"
    stale = written(sync_stale(spark, sf_dir))
    left = nodes.filter(F.col("file_path") != gone)
    old = resolve.resolve_names(refs, imports, resolve.symbol_index(nodes, _modules(nodes)))
    some = refs.join(stale, "file", "left_semi")
    named = left.join(some.select("name").distinct(), "name", "left_semi")
    new = resolve.resolve_names(some, imports.join(stale, "file", "left_semi"), resolve.symbol_index(named, _modules(nodes)))
    kept = old.join(stale, "file", "left_anti").select(*new.columns)
    return kept.unionByName(new).select("from_id", "name", "pkg_alias", "kind", "line", "target")


QUERIES["sync_resolved"] = sync_resolved
ORACLES["sync_resolved"] = _refs_oracle(
    _RESOLVED.replace("WHERE kind <> 'file'", "WHERE kind <> 'file' AND file_path <> 'europe/nation_3/high.go'")
    + " SELECT from_id, name, pkg_alias, kind, line, target FROM res"
)


_STORED = "stored AS (SELECT path, sha256(path) AS h, length(path) AS m, 1 AS s FROM (SELECT DISTINCT file_path AS path FROM nodes) WHERE length(path) % 7 <> 0)"
_DISK = "disk AS (SELECT path, sha256(path || CASE WHEN length(path) % 5 = 0 THEN 'x' ELSE '' END) AS h, length(path) + (length(path) % 5 <= 1)::INT AS m, 1 AS s FROM (SELECT DISTINCT file_path AS path FROM nodes) WHERE length(path) % 11 <> 0)"
_CHANGES = f"""{_STORED}, {_DISK}, changes AS (SELECT coalesce(d.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted'
  WHEN d.m = o.m AND d.s = o.s THEN 'unchanged' WHEN d.h = o.h THEN 'touched' ELSE 'modified' END AS state FROM disk d FULL JOIN stored o ON o.path = d.path)"""


def _two_states(spark, sf_dir):
    f = P.nodes(spark, sf_dir).select(F.col("file_path").alias("path")).distinct()
    n = F.length("path")
    stored = f.filter(n % 7 != 0).select("path", F.sha2("path", 256).alias("content_hash"), n.alias("mtime_unix_ns"), F.lit(1).alias("size_bytes"))
    body = F.concat("path", F.when(n % 5 == 0, "x").otherwise(""))
    disk = f.filter(n % 11 != 0).select("path", body.cast("binary").alias("content"), (n + (n % 5 <= 1).cast("int")).alias("mtime_unix_ns"), F.lit(1).alias("size_bytes"))
    return stored, disk


@query(f"WITH {_CHANGES} SELECT path, state FROM changes")
def sync_changes(spark, sf_dir) -> DataFrame:
    return sync.changes(*_two_states(spark, sf_dir))


_GONE = f"{_CHANGES}, gone AS (SELECT path FROM changes WHERE state IN ('modified', 'deleted'))"


def _gone(spark, sf_dir):
    """Written, a row a file: small enough for Spark to send it to where the nodes are."""
    return written(sync_changes(spark, sf_dir).filter("state IN ('modified', 'deleted')").select("path"))


@query(f"WITH {_GONE} SELECT id FROM nodes WHERE file_path NOT IN (SELECT path FROM gone)")
def sync_pruned_nodes(spark, sf_dir) -> DataFrame:
    return sync.prune_nodes(P.nodes(spark, sf_dir), _gone(spark, sf_dir)).select("id")


@query(f"""WITH {_GONE} SELECT e.kind, count(*) AS n FROM edges e LEFT JOIN nodes s ON s.id = e.source WHERE s.file_path IS NULL OR s.file_path NOT IN (SELECT path FROM gone) GROUP BY e.kind""")
def sync_pruned_edges(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return sync.prune_edges(edges, nodes, _gone(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_GONE} SELECT DISTINCT s.file_path AS path FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source
WHERE e.kind = 'calls' AND t.file_path IN (SELECT path FROM gone) AND s.file_path NOT IN (SELECT path FROM gone)""")
def sync_dependents(spark, sf_dir) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return sync.dependents(edges, nodes, _gone(spark, sf_dir))


# ---- metrics and streams --------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_type AS subject, extract('isodow' FROM ts)::INT AS day, median(value) AS v FROM events GROUP BY 1, 2)
SELECT subject, count(*) AS days, round(median(v), 6)::DOUBLE AS mid, round(min(v), 6)::DOUBLE AS low FROM t GROUP BY subject""", graph=False)
def metric_medians(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    trials = events.groupBy(F.col("event_type").alias("subject"), F.weekday("ts").alias("day")).agg(F.median("value").alias("v"))
    return metrics.medians(trials, "subject", "v")


@query("""WITH k AS (SELECT n_name AS repo, c_mktsegment AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT kind, max(n) AS best, arg_min(repo, (-n, repo)) AS repo, least(greatest(2, max(n) // 2), max(n)) AS threshold FROM k GROUP BY kind""", graph=False)
def coverage_thresholds(spark, sf_dir) -> DataFrame:
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    counts = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("repo"), F.col("c_mktsegment").alias("kind"))
    return metrics.coverage(counts.agg(F.count(F.lit(1)).alias("n")))


@query("""WITH e AS (SELECT event_type, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, user_id ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT event_type, min(ts) AS started, count(DISTINCT user_id) AS n_paths, count(*) AS n_events FROM g GROUP BY event_type, burst""", graph=False)
def debounced_events(spark, sf_dir) -> DataFrame:
    from ..streaming.watch import debounce

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = debounce(events.select("event_type", "ts", F.col("user_id").cast("string").alias("path")), "30 minutes", keys=["event_type"])
    return found.select("event_type", F.col("started"), F.size("paths").cast("long").alias("n_paths"), "n_events")


# ---- ingest ---------------------------------------------------------------------------------------------------------


@query()
def index_synthetic(spark, sf_dir) -> DataFrame:
    """Extracts and resolves a synthetic corpus of 20,000 files; one row a kind of edge."""
    from ..ingest import extract
    from ..sources.discover import synthetic

    sources = written(synthetic(spark, 20_000))
    extracted = written(extract.extract(sources))
    part = lambda name: extract.table(extracted, name)
    made = resolve.resolve(
        part("nodes"), part("edges"), part("refs"), part("imports"), part("iface_methods"), part("method_arity"),
        extract.file_rows(sources, extracted), "bench",
    )
    return made.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'GET /' || lower(r_name) AS name, lower(r_name) || x || '::route:GET /' || lower(r_name) AS qualified_name, lower(r_name) || x AS file_path, f AS by
FROM region, (VALUES ('.go', 'gin-route'), ('.py', 'fastapi-route')) v(x, f)""", graph=False)
def routes_detected(spark, sf_dir) -> DataFrame:
    """Routes of generated handlers, one file a region and framework."""
    from ..ingest import extract

    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lower("r_name").alias("r"))
    go = F.concat(F.lit('package web\n\nfunc Setup(e int) {\n\te.GET("/'), "r", F.lit('", Show)\n}\n\nfunc Show(c int) {}\n'))
    py = F.concat(F.lit('@app.get("/'), "r", F.lit('")\ndef show():\n    return 1\n'))
    sources = r.select(F.concat("r", F.lit(".go")).alias("path"), F.lit("go").alias("language"), go.cast("binary").alias("content"))
    sources = sources.union(r.select(F.concat("r", F.lit(".py")), F.lit("python"), py.cast("binary")))
    sources = sources.withColumn("module_key", F.col("path"))
    extracted = written(extract.extract(sources, "gin-gonic/gin fastapi"))
    nodes, edges = extract.route_graph(extract.table(extracted, "routes"), extract.table(extracted, "nodes"))
    return nodes.join(edges, F.col("id") == F.col("source")).select("name", "qualified_name", "file_path", F.col("metadata")["synthesizedBy"].alias("by"))
