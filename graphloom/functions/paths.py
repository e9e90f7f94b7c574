"""Path predicates and glob patterns as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of directories and shapes of file names that mark tests, examples, icons, translations and
# generated code.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testlib", "testing")
EXAMPLE_DIRS = (
    "integration", "sample", "samples", "example", "examples", "fixture", "fixtures", "benchmark", "benchmarks", "demo", "demos",
)
TEST_NAME = r"^test_|_test\.|\.test\.|-spec\."
TEST_SUFFIX = r"(Test|Tests|TestCase|Spec)\.[^./]+$"
ICON_DIRS = ("icon", "icons", "i18n", "l10n", "locale", "locales", "translation", "translations")
ICON_NAME = r"(?i)^(icons?|i18n|l10n|locales?|translations?)[._-]"
GENERATED = (
    r"\.pb\.go$", r"\.pulsar\.go$", r"_grpc\.pb\.go$", r"_mock\.go$", r"_mocks\.go$", r"^mock_[^/]+\.go$",
    r"\.generated\.[jt]sx?$", r"\.gen\.[jt]sx?$", r"\.pb\.[jt]s$", r"_pb\.[jt]s$", r"_grpc_pb\.[jt]s$", r"\.min\.m?js$",
    r"_pb2(_grpc)?\.py$", r"_pb2\.pyi$", r"\.pb\.(cc|h)$", r"\.g\.cs$", r"Grpc\.cs$", r"OuterClass\.java$", r"Grpc\.java$",
    r"\.pb\.swift$", r"\.g\.dart$", r"\.freezed\.dart$", r"\.pb\.dart$", r"\.pbgrpc\.dart$", r"\.chopper\.dart$",
    r"\.generated\.rs$",
)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal(path: Column) -> Column:
    """For comparing with hints: forward slashes, lower case."""
    return F.lower(slashes(path))


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def file_dir(path: Column) -> Column:
    """Text before the last slash, else empty."""
    return F.regexp_extract(slashes(path), "^(.*)/[^/]*$", 1)


def under(path: Column, top: Column | str) -> Column:
    """Equal to ``top`` or below it on a slash boundary."""
    top = F.lit(top) if isinstance(top, str) else top
    return (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def in_dir(path: Column, directory: str) -> Column:
    """Directory filter: ``dir``, ``dir/...`` and the same with a leading ``./``."""
    directory = directory.rstrip("/")
    return under(path, directory) | under(path, f"./{directory}")


def _some_dir(path: Column, names: tuple[str, ...]) -> Column:
    return F.concat(F.lit("/"), F.lower(file_dir(path)), F.lit("/")).rlike("/(" + "|".join(map(re.escape, names)) + ")/")


def is_test_path(path: Column) -> Column:
    base = base_name(path)
    return (
        base.rlike(TEST_NAME)
        | base.rlike(TEST_SUFFIX)
        | _some_dir(path, TEST_DIRS + EXAMPLE_DIRS)
        | F.contains(file_dir(path), F.lit("Test"))
    )


def is_icon_path(path: Column) -> Column:
    return base_name(path).rlike(ICON_NAME) | _some_dir(path, ICON_DIRS)


def is_low_value(path: Column) -> Column:
    return is_test_path(path) | is_icon_path(path)


def is_generated(path: Column) -> Column:
    return path.rlike("|".join(GENERATED))


def is_test_symbol(path: Column) -> Column:
    """The narrower rule of traversals."""
    return F.endswith(path, F.lit("_test.go"))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell glob: * and ? never match a slash; a malformed one is an error."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(pattern):
                raise ValueError("glob: trailing backslash")
            out.append(re.escape(pattern[k]))
        elif c == "[":
            k += 1
            negate = pattern[k : k + 1] == "^"
            k += negate
            parts: list[str] = []
            while k < len(pattern) and (pattern[k] != "]" or not parts):
                if pattern[k] == "\\":
                    k += 1
                    if k == len(pattern):
                        raise ValueError("glob: trailing backslash")
                    parts.append("\\" + pattern[k])
                elif pattern[k] == "-" and parts and pattern[k + 1 : k + 2] not in ("]", ""):
                    parts.append("-")
                else:
                    parts.append(re.escape(pattern[k]))
                k += 1
            if k == len(pattern):
                raise ValueError("glob: open bracket")
            out.append(("[^" if negate else "[") + "".join(parts) + ("/]" if negate else "]"))
        else:
            out.append(re.escape(c))
        k += 1
    return "^(?:" + "".join(out) + r")\z"


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def go_import_path(module: str, path: Column) -> Column:
    directory = file_dir(path)
    return F.when(directory == "", F.lit(module)).otherwise(F.concat(F.lit(f"{module}/"), directory))


def python_module(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def package_up(package: Column, levels: int) -> Column:
    """Strips trailing dotted segments."""
    parts = F.split(package, r"\.")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), ".")
