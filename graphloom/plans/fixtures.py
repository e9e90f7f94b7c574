"""Queries over small authored inputs whose results are written out as SQL values, and over the driver tables.

They exercise operators that the projected graph cannot: extraction by language, routes, module keys, build rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..ingest import extract, routes
from ..operators import lookup, resolve, status, sync, traverse
from ..sources import discover
from . import metrics
from .catalog import graph, query


def _values(columns: str, rows: list[tuple]) -> str:
    """DuckDB VALUES of authored rows."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


# ---- extraction -----------------------------------------------------------------------------------------------------

#: language: source, declared nodes, references (kind, name, alias).
SAMPLES = {
    "go": (
        'package p\n\nimport x "m/q"\n\ntype T struct{ U }\n\nfunc (t *T) Run(a, b int) int { return x.F(a) + help() }\n\nfunc help() int { return 1 }\n',
        "struct T, method T.Run, function help",
        "imports m/q, embeds U, calls F x, calls help, references a",
    ),
    "python": (
        "from .b import f as g\nclass A(K):\n    def run(self, x: int) -> K:\n        self.help(g(x))\n",
        "struct A, method A.run",
        "imports b, embeds K, returns K, calls f g, calls help",
    ),
    "typescript": (
        "import { foo as bar } from './x';\nexport class A extends B { run() { bar(1); return this.help(); } help() {} }\nexport const f = () => { bar(2); };\n",
        "struct A, method A.run, method A.help, function f",
        "imports src/x, embeds B, calls foo bar, calls help",
    ),
    "java": (
        "package p; import q.R; class A extends B implements C { int run(int a) { help(a); return this.run(a); } void help(int a) {} }",
        "struct A, method A.run, method A.help",
        "imports q.R, embeds B, embeds C, calls help, calls run, references a",
    ),
    "csharp": (
        "using S; namespace N { class A : B { int Run(int x) { return Help(x); } int Help(int x) => x; } }",
        "struct A, method A.Run, method A.Help",
        "imports S, embeds B, calls Help, references x",
    ),
    "c": (
        '#include "a.h"\nstruct S { int x; };\nint help(int a) { return a; }\nint main(void) { return help(1); }\n',
        "struct S, function help, function main",
        "imports a.h, calls help",
    ),
    "cpp": (
        "class A : public B { int run() { return help(); } int help(); };\nint A::help() { return 1; }\n",
        "struct A, method A.run, method A.help",
        "embeds B, calls help",
    ),
    "kotlin": (
        "package p\nclass A(d: I) : B(), I by d {\n  fun run(x: Int): Int { return help(x) }\n}\nfun help(x: Int): Int = x\n",
        "struct A, method A.run, function help",
        "embeds B, embeds I, calls help",
    ),
    "php": (
        "<?php\nuse B\\X\\{C, D as E};\nclass A extends K { function run($x) { $this->help($x); } function help($x) {} }",
        "struct A, method A.run, method A.help",
        "imports B\\X\\C, imports B\\X\\D, embeds K, calls help",
    ),
    "ruby": (
        "class A < B\n  def run(x)\n    help(x)\n  end\n  def help(x)\n  end\nend\n",
        "struct A, method A.run, method A.help",
        "embeds B, calls help",
    ),
    "rust": (
        "struct S; trait T { fn go(&self); } impl T for S { fn go(&self) { help(); } } fn help() {}",
        "struct S, interface T, method T.go, method S.go, function help",
        "embeds T, calls help",
    ),
    "swift": (
        "class A: B {\n func run() { help() }\n}\nprotocol P { }\nfunc help() {}\n",
        "struct A, method A.run, interface P, function help",
        "embeds B, calls help",
    ),
}


def _extracted(language: str):
    source, declared, referred = SAMPLES[language]
    rows = [("node", *x.split(" ", 1), "") for x in declared.split(", ")]
    rows += [("ref", *(x.split(" ") + [""])[:3]) for x in referred.split(", ")]

    def run(spark, sf_dir) -> DataFrame:
        files = spark.createDataFrame([("src/a", language, "m", bytearray(source.encode()))], "path string, language string, module_key string, content binary")
        found = extract.extract(files)
        nodes = extract.table(found, "nodes").filter("kind <> 'file'").select(F.lit("node").alias("part"), "kind", F.col("qualified_name").alias("name"), F.lit("").alias("alias"))
        refs = extract.table(found, "refs").select(F.lit("ref"), "kind", "name", "pkg_alias").distinct()
        return nodes.union(refs)

    run.__name__ = f"extracted_{language}"
    query(_values("part, kind, name, alias", rows), graph=False)(run)


for _language in SAMPLES:
    _extracted(_language)

#: framework: language, manifest, source, (verb, path).
ROUTES = [
    ("gin", "go", "github.com/gin-gonic/gin", 'package w\n\nfunc S(r int) {\n\tr.POST("/p", Save)\n}\n\nfunc Save(c int) {}\n', "POST", "/p"),
    ("express", "javascript", '"express"', "function show(a) {}\napp.get('/a/:id', auth, show);\n", "GET", "/a/:id"),
    ("flask", "python", "flask", "@app.route('/f', methods=['PUT'])\ndef f():\n    pass\n", "PUT", "/f"),
    ("fastapi", "python", "fastapi", "@router.delete('/d')\ndef d():\n    pass\n", "DELETE", "/d"),
    ("nestjs", "typescript", "@nestjs/core", "@Controller('cats')\nclass C { @Get(':id') one() {} }\n", "GET", "/cats/:id"),
    ("spring", "java", "spring-boot", '@RequestMapping("/api")\npublic class C { @GetMapping("/x") int x() { return 1; } }\n', "GET", "/api/x"),
    ("aspnet", "csharp", "Microsoft.AspNetCore", '[Route("api")] class C { [HttpGet("x")] int X() { return 1; } }\n', "GET", "/api/x"),
    ("django", "python", "django", "path('x/', views.index, name='i')\n\ndef index(r):\n    pass\n", "ANY", "x/"),
]


@query(_values("framework, verb, path", [(r[0], r[4], r[5]) for r in ROUTES]), graph=False)
def routes_of_frameworks(spark, sf_dir) -> DataFrame:
    """Each framework's routes, from a file that only its manifest switches on."""
    found = None
    for framework, language, _, source, *_ in ROUTES:
        manifest = routes.SIGNATURES[framework][1][0]
        files = spark.createDataFrame([("src/a", language, "m", bytearray(source.encode()))], "path string, language string, module_key string, content binary")
        rows = extract.table(extract.extract(files, manifest), "routes").filter(F.col("framework") == framework)
        rows = rows.select("framework", F.col("verb"), F.col("route").alias("path"))
        found = rows if found is None else found.union(rows)
    return found


# ---- sources --------------------------------------------------------------------------------------------------------

EXPRESSIONS = [
    ("linux", True), ("windows && amd64", False), ("windows || linux", True), ("!windows", True), ("custom", False), ("!custom && unix", True),
    ("(darwin || linux) && !arm64", True), ("go1.21", True), ("ignore", False), ("linux &&", False),
]


@query(_values("expression, holds", EXPRESSIONS), graph=False)
def build_expressions(spark, sf_dir) -> DataFrame:
    """Which build lines admit a Go file."""
    text = spark.createDataFrame([(x,) for x, _ in EXPRESSIONS], "x string")
    source = F.concat(F.lit("// head\n\n//go:build "), "x", F.lit("\n\npackage a\n"))
    return text.select(discover.build_expression(source).alias("expression")).mapInArrow(discover._holds, "expression string, holds boolean")


@query(_values("path, language", [("a/b.go", "go"), ("B.PY", "python"), ("x.tsx", "tsx"), ("x.d.ts", "typescript"), ("m.mjs", "javascript"), ("k.kts", "kotlin"), ("h.hh", "cpp"), ("h.h", "c"), ("Makefile", ""), ("n.txt", ""), ("r.rb", "ruby"), ("q.rs", "rust"), ("s.swift", "swift"), ("J.java", "java"), ("c.cs", "csharp"), ("p.php", "php")]), graph=False)
def extension_map(spark, sf_dir) -> DataFrame:
    names = "a/b.go B.PY x.tsx x.d.ts m.mjs k.kts h.hh h.h Makefile n.txt r.rb q.rs s.swift J.java c.cs p.php".split()
    return spark.createDataFrame([(x,) for x in names], "path string").withColumn("language", extract.language_of(F.col("path")))


@query(_values("path, module_key", [("web/r.go", "example.org/d/web"), ("main.go", "example.org/d"), ("src/pk/mod.py", "pk.mod"), ("pk/__init__.py", "pk"), ("src/main/java/a/b/C.java", "a.b"), ("lib/x.ts", "lib/x"), ("lib/y.d.ts", "lib/y"), ("app/z.rb", "app/z"), ("Sources/Kit/k.swift", "Kit"), ("php/Sub/K.php", "App.Sub"), ("src/a/mod.rs", "crate::a"), ("c/d.c", "c/d.c")]), graph=False)
def module_keys(spark, sf_dir) -> DataFrame:
    """Under which key the files of a module find each other, by the manifests of the project."""
    manifests = {"go.mod": "module example.org/d\n", "pyproject.toml": "[project]\n", "composer.json": '{"autoload": {"psr-4": {"App\\\\": "php/"}}}', "Cargo.toml": 'name = "c"\n'}
    names = "web/r.go main.go src/pk/mod.py pk/__init__.py src/main/java/a/b/C.java lib/x.ts lib/y.d.ts app/z.rb Sources/Kit/k.swift php/Sub/K.php src/a/mod.rs c/d.c".split()
    rows = spark.createDataFrame([(x,) for x in names], "path string").withColumn("language", extract.language_of(F.col("path")))
    return rows.select("path", discover.module_key(manifests).alias("module_key"))


@query(_values("path, segment, go_path, module, above", [("a/b/c.py", "c.py", "m.org/x/a/b", "a.b.c", "a.b"), ("d/__init__.py", "__init__.py", "m.org/x/d", "d", ""), ("e.py", "e.py", "m.org/x", "e", "")]), graph=False)
def path_functions(spark, sf_dir) -> DataFrame:
    """Last segment, Go import path, Python module and the package one level up."""
    rows = spark.createDataFrame([("a/b/c.py",), ("d/__init__.py",), ("e.py",)], "path string")
    module = paths.python_module(F.col("path"))
    return rows.select("path", paths.last_segment(F.col("path")).alias("segment"), paths.go_import_path("m.org/x", F.col("path")).alias("go_path"), module.alias("module"), paths.package_up(module, 1).alias("above"))


@query(_values("pos, path", [(0, "a.go"), (1, "b c.go"), (2, "d.py")]), graph=False)
def change_list(spark, sf_dir) -> DataFrame:
    """Trimmed, without repeats and blanks, in order."""
    return spark.createDataFrame(list(enumerate(discover.change_list([" a.go ", "b c.go", "", "a.go", "  ", "d.py"]))), "pos int, path string")


@query(_values("name, given, used", [("limit", -1, 1000), ("limit", 0, 1000), ("limit", 7, 7), ("limit", 5000, 1000), ("impact", -1, 2), ("impact", 0, 2), ("impact", 9, 9), ("impact", 999999, 50), ("affected", -1, 5), ("affected", 51, 50)]), graph=False)
def clamps(spark, sf_dir) -> DataFrame:
    """Limits and depths as the operators take them; -1 stands for none given."""
    rows = [("limit", x, lookup.clamp_limit(x)) for x in (None, 0, 7, 5000)]
    rows += [("impact", x, lookup.clamp_depth(x, lookup.IMPACT_DEPTH)) for x in (None, 0, 9, 999_999)]
    rows += [("affected", x, lookup.clamp_depth(x, lookup.AFFECTED_DEPTH)) for x in (None, 51)]
    return spark.createDataFrame([(n, -1 if x is None else x, y) for n, x, y in rows], "name string, given int, used int")


# ---- status, sync and paths over the tables -------------------------------------------------------------------------


@query("""SELECT kind AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS pos FROM nodes GROUP BY kind""")
def sorted_counts(spark, sf_dir) -> DataFrame:
    """Kinds of nodes, largest first."""
    from pyspark.sql import Window

    nodes, _ = graph(spark, sf_dir)
    rows = status.ordered(status.nodes_by_kind(nodes))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "key")))  # a row a kind


@query("SELECT max(epoch_us(ts)) // 1000 AS newest_ms, 1700000000000 AS last_sync_unix_ms, max(epoch_us(ts)) // 1000 > 1700000000000 AS stale FROM events", graph=False)
def staleness(spark, sf_dir) -> DataFrame:
    """Is the newest file on disk newer than the last sync? Events as files."""
    disk = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_unix_ns"))
    return status.staleness(disk, spark.createDataFrame([(1_700_000_000_000,)], "last_sync_unix_ms long"))


@query("""WITH n AS (SELECT file_path AS path, count(*) AS node_count FROM nodes GROUP BY 1
), e AS (SELECT s.file_path AS path FROM edges e JOIN nodes s ON s.id = e.source WHERE e.kind = 'contains'
  UNION ALL SELECT s.file_path FROM edges e JOIN nodes s ON s.id = e.source WHERE e.kind = 'calls')
SELECT path, node_count, (SELECT count(*) FROM e WHERE e.path = n.path) AS edge_count FROM n""")
def per_file_counts(spark, sf_dir) -> DataFrame:
    """Nodes of each file, and its inner edges plus those that its references gave."""
    nodes, edges = graph(spark, sf_dir)
    files = nodes.select(F.col("file_path").alias("path")).distinct().withColumns({"node_count": F.lit(0), "edge_count": F.lit(0)})
    calls = edges.filter("kind = 'calls'").join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file")), "source").select("file")
    return resolve.count_per_file(files, nodes, edges.filter("kind = 'contains'"), calls).select("path", "node_count", "edge_count")


@query(_values("state, anew", [("none", True), ("old", True), ("current", False)]), graph=False)
def backfill_decision(spark, sf_dir) -> DataFrame:
    """An index that is missing, or has no file index, is built anew."""
    old, now = (spark.createDataFrame([(x,)], "has_file_index boolean") for x in (False, True))
    return spark.createDataFrame([(k, sync.needs_full_run(m)) for k, m in (("none", None), ("old", old), ("current", now))], "state string, anew boolean")


@query("""SELECT DISTINCT file_path FROM nodes WHERE kind = 'method' AND regexp_matches(file_path, '^[^/]*/[^/]*a[^/]*$') AND NOT contains(file_path, chr(10))""")
def affected_paths(spark, sf_dir) -> DataFrame:
    """Distinct files by a glob on the whole path."""
    nodes, _ = graph(spark, sf_dir)
    return traverse.affected_paths(nodes.filter("kind = 'method'"), "*/*a*")


@query(_values("subject, ok, reason", [("a", True, ""), ("b", False, "throughput"), ("c", False, "memory"), ("d", False, "another platform"), ("e", False, "no baseline"), ("f", False, "memory ceiling")]), graph=False)
def benchmark_gate(spark, sf_dir) -> DataFrame:
    """Throughput, memory and the ceiling against a baseline of the same platform."""
    columns = "subject string, goos string, goarch string, runner string, scratch_fs string, files_per_sec double, peak_rss_bytes long"
    base = [(x, "linux", "amd64", "u", "disk", 1000.0, 10**9) for x in "abcd"] + [("f", "linux", "amd64", "u", "disk", 1000.0, 5 * 10**9)]
    now = [
        ("a", "linux", "amd64", "u", "disk", 950.0, 11 * 10**8), ("b", "linux", "amd64", "u", "disk", 890.0, 10**9), ("c", "linux", "amd64", "u", "disk", 1000.0, 12 * 10**8),
        ("d", "darwin", "arm64", "u", "disk", 1000.0, 10**9), ("e", "linux", "amd64", "u", "disk", 1000.0, 10**9), ("f", "linux", "amd64", "u", "disk", 1000.0, 5 * 10**9),
    ]
    return metrics.gate(spark.createDataFrame(now, columns), spark.createDataFrame(base, columns))
