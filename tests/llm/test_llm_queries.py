import pytest

from tallyloom.llm.queries import ORACLES, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
