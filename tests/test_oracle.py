"""Every registered query against its DuckDB statement on the smallest test tables."""

import oracle
import pytest

from linkloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches(spark, con, name):
    problems, count, _ = oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert not problems
    assert count > 0


def test_registries_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
