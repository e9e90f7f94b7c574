import os
import shutil

import pytest

from graphloom import schema
from graphloom.api import CodeGraph
from graphloom.ingest import extract, routes
from graphloom.operators import resolve, sync
from graphloom.sources import discover
from graphloom.sources.snapshot import Snapshots, load

GO = {
    "go.mod": "module example.org/demo\n\nrequire github.com/gin-gonic/gin v1\n",
    "shapes/shape.go": "package shapes\n\ntype Shape interface {\n\tArea(k int) int\n\tName() string\n}\n\ntype Base struct{}\n\nfunc (b *Base) Name() string { return label }\n\nconst label = \"b\"\n",
    "shapes/square.go": "package shapes\n\ntype Square struct {\n\tBase\n\tside int\n}\n\nfunc (s *Square) Area(k int) int { return helper(k) }\n\nfunc (s *Square) Name() string { return \"s\" }\n\nfunc helper(k int) int { return k }\n",
    "main/main.go": "package main\n\nimport \"example.org/demo/shapes\"\n\nfunc Run() *shapes.Square { s := &shapes.Square{}; return s }\n",
    "main/main_test.go": "package main\n\nfunc TestRun() { Run() }\n",
    "web/r.go": "package web\n\nfunc Setup(r int) {\n\tr.GET(\"/a\", Show)\n}\n\nfunc Show(c int) {}\n",
    "vendor/v/v.go": "package v\n\nfunc Hidden() {}\n",
    "x_windows.go": "package x\n\nfunc Win() {}\n",
    "tool.py": "class Tool:\n    def run(self): return helper(LIMIT)\n\ndef helper(x): return x\n",
    "bad.py": "def broken(:\n",
}


def write(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    write(root, GO)
    return root


@pytest.fixture(scope="module")
def graph(spark, tree, tmp_path_factory):
    g = CodeGraph(spark, str(tmp_path_factory.mktemp("store")))
    g.index(tree)
    return g


def named_edges(g):
    n = {r["id"]: r["qualified_name"] for r in g.nodes.collect()}
    return {(r["kind"], n.get(r["source"]), n.get(r["target"])) for r in g.edges.collect()}


def test_index_of_a_small_tree(graph):
    e = named_edges(graph)
    assert ("implements", "Square", "Shape") in e and ("extends", "Square", "Base") in e
    assert ("overrides", "Square.Name", "Base.Name") in e and ("calls", "TestRun", "Run") in e
    assert ("instantiates", "Run", "Square") in e and ("returns", "Run", "Square") in e
    assert ("imports", "main/main.go", "example.org/demo/shapes") in e
    assert ("calls", "web/r.go::route:GET /a", "Show") in e
    names = {r["name"] for r in graph.nodes.collect()}
    assert not {"Hidden", "Win"} & names


def test_broken_files_keep_their_error(graph):
    row = graph.files_table.filter("path = 'bad.py'").first()
    assert row["errors"] and row["node_count"] == 1


def test_queries_of_the_api(graph):
    assert [r["name"] for r in graph.affected(["main/main.go"]).collect()] == ["TestRun"]
    assert graph.files(language="python").count() == 2 and graph.files(directory="shapes", pattern="shapes/*.go").count() == 2
    shown = graph.node("Name").collect()
    assert len(shown) == 2 and all(r["shown"] for r in shown) and "return" in shown[0]["body"]
    assert [r["text"] for r in graph.source("tool.py", 1, 2).collect()] == ["class Tool:", "    def run(self): return helper(LIMIT)"]
    assert graph.source("../outside").count() == 0
    assert not graph.is_stale("/nonexistent") if os.path.exists("/nonexistent") else True


def test_sync_equals_a_full_run(spark, tree, tmp_path):
    root = str(tmp_path / "copy")
    shutil.copytree(tree, root)
    g = CodeGraph(spark, str(tmp_path / "a"))
    g.index(root)
    assert g.sync(root).count() == 0
    write(root, {"shapes/square.go": GO["shapes/square.go"].replace("helper(k)", "k") + "\nfunc Extra() {}\n", "new/n.go": "package new\n\nfunc N() {}\n"})
    os.remove(os.path.join(root, "tool.py"))
    states = {r["path"]: r["state"] for r in g.sync(root).collect()}
    assert states == {"shapes/square.go": "modified", "new/n.go": "added", "tool.py": "deleted"}
    full = CodeGraph(spark, str(tmp_path / "b"))
    full.index(root)
    for table in ("nodes", "edges", "files"):
        columns = [c for c in full.table(table).columns if c != "metadata"]
        assert sorted(map(str, g.table(table).select(columns).collect())) == sorted(map(str, full.table(table).select(columns).collect()))


def test_sync_looks_up_only_what_depends_on_a_change(spark, tmp_path):
    """A declaration that moves, goes and comes back reaches files that did not change; others keep their outcome."""
    root = str(tmp_path / "src")
    go = lambda package, body: f"package {package}\n\n{body}\n"
    write(root, {
        "go.mod": "module example.org/s\n", "a/x.go": go("a", "func Help() {}"), "a/y.go": go("a", "func Use() { Help() }"),
        "b/z.go": go("b", 'import "example.org/s/a"\n\nfunc Far() { a.Help() }'), "c/w.go": go("c", "func Alone() { Other() }\nfunc Other() {}"),
    })
    g = CodeGraph(spark, str(tmp_path / "a"))
    g.index(root)

    def check(n: int) -> None:
        full = CodeGraph(spark, str(tmp_path / f"full{n}"))
        full.index(root)
        for table in ("nodes", "edges", "files"):
            columns = [c for c in full.table(table).columns if c not in ("metadata", "mtime_unix_ns")]
            assert sorted(map(str, g.table(table).select(columns).collect())) == sorted(map(str, full.table(table).select(columns).collect()))

    calls = lambda: {(r["source"], r["target"]) for r in g.edges.filter("kind = 'calls'").collect()}
    assert len(calls()) == 3
    write(root, {"a/x.go": go("a", "func Helped() {}")})
    g.sync(root)
    assert len(calls()) == 1
    check(1)
    write(root, {"a/x2.go": go("a", "func Help() {}")})
    g.sync(root)
    assert len(calls()) == 3
    check(2)
    declared = spark.createDataFrame([("example.org/s/a", "Help")], "module_key string, name string")
    changed = spark.createDataFrame([("a/x2.go",)], "path string")
    asked = resolve.lookups(g.table("refs"), g.table("imports"))
    assert {r[0] for r in sync.stale_files(asked, declared, changed).collect()} == {"a/x2.go", "a/y.go", "b/z.go"}


def test_export_and_import(spark, graph, tmp_path):
    graph.export(str(tmp_path / "x"))
    back = load(spark, str(tmp_path / "x"))
    for table in ("nodes", "edges", "files", "meta"):
        key = lambda df: sorted(map(str, df.collect()))
        columns = back[table].columns
        assert key(back[table]) == key(graph.table(table).select(columns))
    other = CodeGraph(spark, str(tmp_path / "y"))
    assert other.import_from(str(tmp_path / "x")) == 1 and other.nodes.count() == graph.nodes.count()


SAMPLES = {
    "java": ("package p; import q.R; class A extends B implements C { private R r = new R(); int run(int a) { help(a); R.make(); r.go(); return this.run(a); } void help(int a) {} }",
             {("method", "A.run"), ("method", "A.help"), ("struct", "A")}, {("embeds", "B", ""), ("embeds", "C", ""), ("calls", "help", ""), ("calls", "go", "<local:r>"), ("calls", "run", "")}),
    "csharp": ("using S; namespace N { class A : B { int Run(int x) { return Help(x); } int Help(int x) => x; } }", {("method", "A.Run"), ("method", "A.Help")}, {("embeds", "B", ""), ("calls", "Help", "")}),
    "typescript": ("import { foo as bar } from './x';\nexport class A extends B { run() { bar(1); return this.help(); } help() {} }\nexport const f = () => { bar(2); };\n", {("method", "A.run"), ("function", "f")}, {("calls", "foo", "bar"), ("calls", "help", "")}),
    "c": ("#include \"a.h\"\nstruct S { int x; };\nint help(int a) { return a; }\nint main(void) { return help(1); }\n", {("struct", "S"), ("function", "main"), ("function", "help")}, {("calls", "help", ""), ("imports", "a.h", "")}),
    "cpp": ("class A : public B { int run() { return help(); } int help(); };\nint A::help() { return 1; }\n", {("method", "A.run"), ("method", "A.help")}, {("embeds", "B", ""), ("calls", "help", "")}),
    "kotlin": ("package p\nclass A : B(), C {\n  fun run(x: Int): Int { return help(x) }\n}\nfun help(x: Int): Int = x\n", {("method", "A.run"), ("function", "help")}, {("embeds", "B", ""), ("embeds", "C", ""), ("calls", "help", "")}),
    "php": ("<?php class A extends B { function run($x) { $this->help($x); } function help($x) {} }", {("method", "A.run"), ("method", "A.help")}, {("embeds", "B", ""), ("calls", "help", "")}),
    "ruby": ("class A < B\n  def run(x)\n    help(x)\n  end\n  def help(x)\n  end\nend\n", {("method", "A.run"), ("method", "A.help")}, {("embeds", "B", ""), ("calls", "help", "")}),
    "rust": ("struct S; trait T { fn go(&self); } impl T for S { fn go(&self) { help(); } } fn help() {}", {("method", "S.go"), ("interface", "T"), ("function", "help")}, {("embeds", "T", ""), ("calls", "help", "")}),
    "swift": ("class A: B {\n func run() { help() }\n}\nprotocol P { }\nfunc help() {}\n", {("method", "A.run"), ("interface", "P"), ("function", "help")}, {("embeds", "B", ""), ("calls", "help", "")}),
    "python": ("from .b import f as g\nclass A(K):\n    def run(self, x: int) -> K:\n        self.help(g(x))\n", {("method", "A.run")}, {("embeds", "K", ""), ("calls", "help", ""), ("calls", "f", "g"), ("returns", "K", "")}),
    "go": ("package p\n\nimport x \"m/q\"\n\ntype T struct{ U }\n\nfunc (t *T) Run(a, b int) int { return x.F(a) + help() }\n\nfunc help() int { return 1 }\n", {("method", "T.Run"), ("function", "help")}, {("embeds", "U", ""), ("calls", "F", "x"), ("calls", "help", "")}),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_extractors(language):
    source, symbols, refs = SAMPLES[language]
    row = extract.extract_file("d/a", language, "m", source.encode())
    assert not row["error"]
    assert symbols <= {(n["kind"], n["qualified_name"]) for n in row["nodes"]}
    assert refs <= {(r["kind"], r["name"], r["pkg_alias"]) for r in row["refs"]}


@pytest.mark.parametrize("language", list(extract.LANGUAGES))
@pytest.mark.parametrize("source", ["", "{", "}}}}", "((((", "\x00\xff", "class", "func (", "import", '"' * 7, "type X", "a\n" * 3, "{" * 3000])
def test_extractors_survive_anything(language, source):
    row = extract.extract_file("p/a", language, "m", source.encode())
    assert row["nodes"][0]["kind"] == "file"


def refs_of(language, source, script=None):
    row = extract.extract_file("src/a.ts" if language == "typescript" else "d/a", language, "m", source.encode(), "", script)
    assert not row["error"]
    return row


def test_large_files_are_parsed_whole():
    body = "package p\n" + "".join(f"func F{k}() int {{ return G{k}() }}\n" for k in range(140_000))
    assert len(body) > 5 << 20
    row = extract.extract_file("p/a.go", "go", "m", body.encode())
    assert not row["error"] and sum(n["kind"] == "function" for n in row["nodes"]) == 140_000


def test_import_of_two_hundred_names():
    names = ", ".join(f"n{k} as m{k}" for k in range(200))
    row = refs_of("typescript", f"import {{ {names} }} from './lib/x';\nfunction f() {{ m199(); }}")
    assert ("imports", "src/lib/x", "") in {(r["kind"], r["name"], r["pkg_alias"]) for r in row["refs"]}
    assert {i["alias"]: i["target_module"] for i in row["imports"]} == {f"m{k}": "src/lib/x" for k in range(200)}


@pytest.mark.parametrize("options, target, want", [
    ({"baseUrl": "src", "paths": {"@app/*": ["app/*"]}}, "@app/x/y", "src/app/x/y"),
    ({"baseUrl": ".", "paths": {"@lib": ["lib/index.ts"], "@*": ["other/*"]}}, "@lib", "other/lib"),
    ({"baseUrl": "", "paths": {"exact": ["e/f.ts"]}}, "exact", "e/f"),
    ({"baseUrl": "src"}, "util/z", "src/util/z"),
    ({}, "react", "react"),
])
def test_script_modules_by_compiler_options(options, target, want):
    row = refs_of("typescript", f"import {{ a }} from '{target}';", options)
    assert [r["name"] for r in row["refs"] if r["kind"] == "imports"] == [want]


def test_script_options():
    text = '{"compilerOptions": {"baseUrl": "./src", "paths": {"@a/*": ["x/*"], "b": "no"}}}'
    assert discover.script_options({"tsconfig.json": text}) == {"baseUrl": "./src", "paths": {"@a/*": ["x/*"]}}
    assert discover.script_options({"tsconfig.json": "{ // c\n}"}) == {} and discover.script_options({}) == {"baseUrl": "", "paths": {}}


def test_group_use():
    row = refs_of("php", "<?php\nnamespace A;\nuse B\\X\\{C, D as E};\nuse function F\\g;\nuse H\\I;\n")
    assert {r["name"] for r in row["refs"] if r["kind"] == "imports"} == {"B\\X\\C", "B\\X\\D", "F\\g", "H\\I"}
    assert {i["alias"]: i["target_module"] for i in row["imports"]} == {"C": "B.X", "E": "B.X", "g": "F", "I": "H"}


def test_delegates_are_no_supertypes():
    row = refs_of("kotlin", "class A(d: I, e: J) : I by d, J by make(e, 1), K() {\n fun f() {}\n}")
    assert {r["name"] for r in row["refs"] if r["kind"] == "embeds"} == {"I", "J", "K"}


@pytest.mark.parametrize("expression, holds", [
    ("linux", True), ("windows && amd64", False), ("windows || linux", True), ("!windows", True), ("custom", False), ("!custom && unix", True),
    ("(darwin || linux) && !(arm64 || cgo)", False), ("go1.21", True), ("ignore", False), ("linux &&", False), ("(linux", False), ("!!linux", True),
])
def test_build_expressions(expression, holds):
    assert discover.build_tag_holds(expression) == holds


def test_build_lines_decide_which_files_are_read(spark, tmp_path):
    write(str(tmp_path), {
        "a.go": "// c\n\n//go:build linux && !race\n\npackage a\n", "b.go": "//go:build windows && amd64\n\npackage a\n", "C.GO": "package a\n",
        "d.go": "package a\n//go:build ignore\n", "e.go": "//go:build mytag\npackage a\n", "f.py": "x = 1\n", "g.png": "no", ".git/h.go": "package a\n",
    })
    assert {r["path"] for r in discover.discover(spark, str(tmp_path)).collect()} == {"a.go", "C.GO", "d.go", "f.py"}


@pytest.mark.parametrize("wrong", ["    x = = 1", "    return (", "  bad indent", "def broken(:"])
def test_python_around_syntax_errors(wrong):
    source = f"import os\nclass A:\n    def f(self): return g()\n{wrong}\n    def h(self): pass\n\ndef g(): return 1\n"
    row = extract.extract_file("d/a", "python", "m", source.encode())
    assert {"A", "f", "g"} <= {n["name"] for n in row["nodes"]} and row["error"].startswith("SyntaxError")
    many = "".join(f"def f{k}(): return {k}\nx{k} = = 1\n" for k in range(60))
    assert {f"f{k}" for k in range(60)} <= {n["name"] for n in extract.extract_file("d/a", "python", "m", many.encode())["nodes"]}


def test_commits_are_whole(spark, tmp_path):
    """A version that was not committed is not read; a version is committed once."""
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() == 0 and store.read("nodes").count() == 0
    rows = lambda n: {"nodes": schema.conform(spark.range(n).selectExpr("CAST(id AS STRING) AS id"), schema.NODES)}
    assert store.write(rows(2)) == 1 and store.write(rows(3)) == 2
    rows(9)["nodes"].write.parquet(f"{store.root}/v=3/nodes")  # a writer that stopped
    assert store.current() == 2 and store.read("nodes").count() == 3
    with pytest.raises(Exception, match="exist"):
        store.commit(2)


ROUTES = {
    "gin": ("go", 'r.POST("/p", Save)', ("POST", "/p", "Save")),
    "express": ("javascript", "app.get('/a/:id', auth, show)", ("GET", "/a/:id", "show")),
    "django": ("python", "path('x/', views.index, name='i')", ("ANY", "x/", "index")),
    "flask": ("python", "@app.route('/f', methods=['PUT'])\ndef f(): pass", ("PUT", "/f", "")),
    "fastapi": ("python", "@router.delete('/d')\ndef d(): pass", ("DELETE", "/d", "")),
    "nestjs": ("typescript", "@Controller('cats')\nclass C { @Get(':id') one() {} }", ("GET", "/cats/:id", "")),
    "spring": ("java", '@RequestMapping("/api")\npublic class C { @GetMapping("/x") int x() {} }', ("GET", "/api/x", "")),
    "aspnet": ("csharp", '[Route("api")] class C { [HttpGet("x")] int X() {} }', ("GET", "/api/x", "")),
}


@pytest.mark.parametrize("framework", ROUTES)
def test_routes(framework):
    language, source, want = ROUTES[framework]
    assert [tuple(r[:3]) for r in routes.detect(framework, source)] == [want]
    assert framework in routes.fired(language, routes.SIGNATURES[framework][1][0]) and not routes.fired(language, "nothing")


def test_change_lists():
    assert discover.change_list([" a ", "b", "", "a"]) == ["a", "b"]
    for bad in (["x" * 5000], [str(k) for k in range(10_001)]):
        with pytest.raises(ValueError):
            discover.change_list(bad)


def test_synthetic_corpus_resolves(spark):
    sources = discover.synthetic(spark, 200)
    assert {r["language"] for r in sources.select("language").distinct().collect()} == {"go", "python", "javascript"}
    assert sorted(map(str, sources.collect())) == sorted(map(str, discover.synthetic(spark, 200).collect()))
