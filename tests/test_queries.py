import pytest

import __spark_entry__
from tallyloom.plans.queries import ORACLES, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["gene_id", "effect_size", "neg_log10_p", "neg_log10_q"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
