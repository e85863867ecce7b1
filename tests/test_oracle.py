"""Every registered query against its DuckDB twin (rows-only when it has none)."""

import pytest

import __spark_entry__ as E
from prism.plans.registry import ORACLE, QUERIES
from tests.oracle_check import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[0] == "column_name"


def test_every_query_has_oracle_or_is_listed():
    no_sql = set(QUERIES) - set(ORACLE)
    assert no_sql <= {"kmeans", "describe_numeric_approx"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    status, nrows, _, info = compare(spark, sf_dir, name, con)
    assert status in ("ok", "rows-only"), info
    assert nrows >= 0
