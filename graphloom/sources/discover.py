"""Source trees: discovery, project descriptors, module keys, change lists and a synthetic corpus."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from ..ingest.brace_source import strip_script
from ..ingest.extract import LANGUAGES, language_of

MOST_LINE, MOST_FILES = 4096, 10_000
#: Operating systems and architectures whose suffix ties a Go file to them.
OTHER_SYSTEMS = ("windows", "darwin", "freebsd", "netbsd", "openbsd", "solaris", "plan9", "js", "wasip1", "aix", "android", "ios")
OTHER_MACHINES = ("386", "arm", "arm64", "wasm", "ppc64", "ppc64le", "mips", "mipsle", "mips64", "mips64le", "riscv64", "s390x", "loong64")


def skipped(path: Column) -> Column:
    """In a vendor folder or one whose name starts with a dot."""
    return F.concat(F.lit("/"), paths.file_dir(path), F.lit("/")).rlike(r"/(vendor|\.[^/]+)/")


def other_platform(path: Column) -> Column:
    """A Go file whose name binds it to another system than Linux on amd64."""
    stem = F.regexp_replace(F.regexp_replace(paths.base_name(path), r"\.go$", ""), "_test$", "")
    return F.endswith(path, F.lit(".go")) & stem.rlike(f"_({'|'.join(OTHER_SYSTEMS + OTHER_MACHINES)})$")


#: The build tags that hold for Linux on amd64.
TAGS = ("linux", "amd64", "unix", "gc", "cgo")


def build_tag_holds(expression: str) -> bool:
    """A build expression (names, !, &&, ||, parentheses) for Linux on amd64; one that cannot be read does not hold."""
    tokens = re.findall(r"\s*(&&|\|\||[!()]|[\w.]+)", expression) + [""]
    k = 0

    def either() -> bool:
        nonlocal k
        found = both()
        while tokens[k] == "||":
            k += 1
            found = both() or found
        return found

    def both() -> bool:
        nonlocal k
        found = one()
        while tokens[k] == "&&":
            k += 1
            found = one() and found
        return found

    def one() -> bool:
        nonlocal k
        now = tokens[k]
        k += 1
        if now == "!":
            return not one()
        if now == "(":
            found = either()
            if tokens[k] != ")":
                raise ValueError(expression)
            k += 1
            return found
        if not re.fullmatch(r"[\w.]+", now):
            raise ValueError(expression)
        return now in TAGS or bool(re.fullmatch(r"go1(\.\d+)?", now))

    try:
        return either() and tokens[k] == ""
    except (ValueError, IndexError):
        return False


def _holds(batches):
    """expression -> expression, holds."""
    for batch in batches:
        found = [build_tag_holds(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], ["expression", "holds"])


def build_expression(content: Column) -> Column:
    """The expression of a leading build line; empty if there is none."""
    return F.regexp_extract(content.cast("string"), r"(?m)\A(?:\s*//[^\n]*\n|\s*\n)*?//go:build ([^\n]+)", 1)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, content, mtime_unix_ns, size_bytes, language of the registered files under ``root`` (any store Spark reads)."""
    either = lambda end: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in end[1:])
    ends = ",".join(sorted(either(e) for x in LANGUAGES.values() for e in x.extensions))  # other files are not opened
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{ends}}}").load(root)
    top = F.regexp_replace(F.lit(root.rstrip("/")), r"^\w+:/*", "/")
    full = F.regexp_replace("path", r"^\w+:/+(?=[^/])", "/")
    rows = read.withColumn("path", F.substring(full, F.length(top) + 2, F.lit(1 << 30)))
    rows = rows.withColumn("language", language_of(F.col("path")))
    kept = rows.filter((F.col("language") != "") & ~skipped(F.col("path")) & ~other_platform(F.col("path")))
    kept = kept.withColumn("expression", F.when(F.col("language") == "go", build_expression(F.col("content"))).otherwise(""))
    asked = kept.filter("expression <> ''").select("expression").distinct().mapInArrow(_holds, "expression string, holds boolean")
    kept = kept.join(asked.filter("not holds").select("expression"), "expression", "left_anti")
    return kept.select(
        "path", "language", "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_unix_ns"), F.col("length").alias("size_bytes")
    )


def descriptors(spark: SparkSession, root: str) -> dict[str, str]:
    """Text of the project's manifests (a fixed list of names at the root)."""
    names = ("go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "setup.py", "requirements.txt", "Pipfile", "composer.json", "Cargo.toml", "tsconfig.json", "package.json", "CMakeLists.txt", "Gemfile", "Package.swift", "*.csproj")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    rows = read.select("path", F.col("content").cast("string").alias("text")).limit(64).collect()  # manifests of one folder
    return {os.path.basename(r["path"]): r["text"] for r in rows}


def _first(pattern: str, text: str) -> str:
    m = re.search(pattern, text or "", re.MULTILINE)
    return m.group(1) if m else ""


def go_module(found: dict[str, str]) -> str:
    return _first(r"^module\s+(\S+)", found.get("go.mod", ""))


def module_key(found: dict[str, str]) -> Column:
    """The key under which files of one module find each other; without a descriptor the path itself."""
    path, lang = F.col("path"), F.col("language")
    module, crate = go_module(found), _first(r'^name\s*=\s*"([^"]+)"', found.get("Cargo.toml", ""))
    directory = paths.file_dir(path)
    go = paths.go_import_path(module, path) if module else F.when(directory == "", F.lit(".")).otherwise(directory)
    dotted = F.replace(directory, F.lit("/"), F.lit("."))
    java = F.regexp_replace(dotted, r"^src\.(main|test)\.(java|kotlin)\.?", "")
    space = next((_first(r"<RootNamespace>([^<]+)<", t) for k, t in found.items() if k.endswith(".csproj")), "")
    python = paths.python_module(F.regexp_replace(path, "^src/", "") if "pyproject.toml" in found or "setup.py" in found else path)
    script = F.regexp_replace(path, r"(\.d\.ts|\.[cm]?[tj]sx?)$", "")
    rust = F.concat(F.lit("crate::"), F.replace(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"(/mod)?\.rs$", ""), F.lit("/"), F.lit("::")))
    key = (
        F.when(lang == "go", go)
        .when(lang == "python", python)
        .when(lang == "java", java)
        .when(lang == "csharp", F.concat_ws(".", *([F.lit(space)] if space else []), F.when(dotted != "", dotted)))
        .when(lang.isin("typescript", "tsx", "javascript"), script)
        .when(lang == "ruby", F.regexp_replace(path, r"\.rb$", ""))
        .when(lang == "swift", F.regexp_replace(directory, "^Sources/", ""))
        .when((lang == "rust") & F.lit(bool(crate)), rust)
    )
    php = psr4(found.get("composer.json", ""), path, directory)
    key = key.when(lang == "php", php) if php is not None else key
    return key.otherwise(path)


def psr4(composer: str, path: Column, directory: Column) -> Column | None:
    """Namespace of a file by the longest folder prefix of the autoload table."""
    try:
        table = json.loads(composer or "{}").get("autoload", {}).get("psr-4", {})
    except ValueError:
        table = {}
    entries = [(str(d).rstrip("/"), ns.rstrip("\\")) for ns, ds in table.items() for d in (ds if isinstance(ds, list) else [ds])]
    key = None
    for folder, space in sorted(entries, key=lambda e: -len(e[0])):
        rest = F.substring(directory, len(folder) + 2, 1 << 30)
        name = F.concat_ws(".", F.lit(space.replace("\\", ".")), F.when(rest != "", F.replace(rest, F.lit("/"), F.lit("."))))
        here = paths.under(directory, folder) if folder else F.lit(True)
        key = key.when(here, name) if key is not None else F.when(here, name)
    return key.otherwise(path) if key is not None else None


def sources(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, str]]:
    """The sources table of a tree, and its manifests."""
    found = descriptors(spark, root)
    rows = discover(spark, root).withColumn("module_key", module_key(found))
    return schema.conform(rows, schema.SOURCES), found


def script_options(found: dict[str, str]) -> dict:
    """``baseUrl`` and ``paths`` of the script compiler's options; a file that is no plain JSON gives none."""
    try:
        options = json.loads(found.get("tsconfig.json") or "{}").get("compilerOptions") or {}
        paths_ = {str(k): [str(x) for x in v] for k, v in (options.get("paths") or {}).items() if isinstance(v, list)}
        return {"baseUrl": str(options.get("baseUrl") or ""), "paths": paths_}
    except (ValueError, AttributeError):
        return {}


def manifest_text(found: dict[str, str]) -> str:
    return "\n".join(found[k] for k in sorted(found))


def script_key(path: str) -> str:
    return strip_script(path)


def change_list(lines: list[str]) -> list[str]:
    """Paths of a change list: trimmed, without repeats, in order; bounded in length and number."""
    out: dict[str, None] = {}
    for line in lines:
        if len(line.encode()) > MOST_LINE:
            raise ValueError(f"a line has more than {MOST_LINE} bytes")
        if line.strip():
            out.setdefault(line.strip())
        if len(out) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files")
    return list(out)


def synthetic(spark: SparkSession, files: int, seed: int = 42) -> DataFrame:
    """A corpus of ``files`` sources: 85 % Go, 10 % Python, 5 % JavaScript; functions call the next file of a package of 25."""
    n = spark.range(files)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    lang = F.when(draw < 85, "go").when(draw < 95, "python").otherwise("javascript")
    end = F.element_at(F.create_map(*[F.lit(x) for k in ("go", "python", "javascript") for x in (k, LANGUAGES[k].extensions[0])]), lang)
    package = F.expr("id div 25")
    path = F.concat(F.lit("pkg"), package, F.lit("/f"), F.col("id"), end)
    own, following = F.concat(F.lit("F"), F.col("id")), F.concat(F.lit("F"), F.when(F.col("id") % 25 == 24, package * 25).otherwise(F.col("id") + 1))
    text = (
        F.when(lang == "go", F.concat(F.lit("package pkg"), package, F.lit("\n\nfunc "), own, F.lit("(n int) int {\n\treturn "), following, F.lit("(n - 1)\n}\n")))
        .when(lang == "python", F.concat(F.lit("def "), own, F.lit("(n):\n    return "), following, F.lit("(n - 1)\n")))
        .otherwise(F.concat(F.lit("export function "), own, F.lit("(n) {\n  return "), following, F.lit("(n - 1);\n}\n")))
    )
    rows = n.select(path.alias("path"), lang.alias("language"), F.concat(F.lit("bench/pkg"), package).alias("module_key"), text.cast("binary").alias("content"))
    return schema.conform(rows.withColumn("size_bytes", F.length("content")), schema.SOURCES)
