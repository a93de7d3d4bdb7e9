"""Every named query against its check query, in another engine."""

import pytest

import __spark_entry__ as contract
from tests import compare
from visitlens.plans import catalog

CHECKS = catalog.CHECKS


@pytest.fixture(scope="module")
def engine(sample_dir):
    pytest.importorskip("duckdb")
    return compare.check_engine(sample_dir)


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(CHECKS)
    assert set(contract.queries()) >= set(contract.oracle_sql()) >= set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, sample_dir, engine, name):
    df = catalog.QUERIES[name](spark, sample_dir)
    assert compare.spark_rows(df) == compare.check_rows(engine, CHECKS[name])
    assert not compare.type_differences(
        compare.spark_types(df), compare.check_types(engine, CHECKS[name]))


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
