"""Registered queries against their statements, and their edge cases together with brute force."""

import oracle
import pytest

from linkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches(spark, con, name):
    problems, count, _ = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert not problems
    assert count > 0


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
