"""The operators that SQL can express, against their DuckDB twins."""

import pytest

import __spark_entry__ as E
from prism.llm import queries
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, sf_dir, name):
    status, rows, _, info = compare(spark, sf_dir, name, duck(sf_dir))
    assert status == "ok", info
    assert rows > 0


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in E.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in E.queries()
