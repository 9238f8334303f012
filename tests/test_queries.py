"""Every registered query with a SQL twin gives the twin's rows."""

import pytest
from compare import connection, of_duckdb, of_spark

from framelake.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(name, spark, sf, con):
    assert of_spark(QUERIES[name](spark, sf)) == of_duckdb(con, ORACLES[name])


def test_entry_is_registered():
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_llm_is_not_needed():
    """No module outside llm imports it."""
    from pathlib import Path

    import framelake

    for p in Path(framelake.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "framelake.llm" not in p.read_text()
