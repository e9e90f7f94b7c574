"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import pytest

from graphloom.plans import catalog, file_queries, fixtures  # noqa: F401  the last two add their queries to the catalog
from tests.conftest import SF, same_as_sql


@pytest.mark.parametrize("name", [k for k in catalog.QUERIES if k != "index_synthetic"])
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same_as_sql(found, catalog.ORACLES[name])
    else:
        assert found.columns


def test_entry_imports_and_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_need_the_corpus_operators():
    """Nothing outside of the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.MULTILINE), path
