"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from lexmill.plans import catalog
from tests.compare import compare, duck

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, con, name):
    line = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE[name], SF)
    assert line.startswith("ok"), line


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "chunk_index"] and df.limit(1).count() == 1
