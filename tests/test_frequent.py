"""Most frequent values: sketch, exact candidates, the proof, and columns that are counted whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from prism.operators import describe as D
from prism.operators import frequent


def slow_top(values, n):
    counts = Counter(v for v in values if v is not None)
    return [(i, v, c) for i, (v, c) in enumerate(sorted(counts.items(), key=lambda r: (-r[1], r[0].encode()))[:n], 1)]


LONG = "x" * 70_000
COLUMNS = {
    "few": lambda i: "abc"[i % 3],
    "a.b": lambda i: None if i % 4 else f"v{i % 7}",
    "hot": lambda i: "hot" if i % 3 == 0 else f"k{i}",
    "skewed": lambda i: f"h{i % 12}" if i % 2 else f"tail{i}",
    "keys": lambda i: f"key{i:05d}",
    "texts": lambda i: f"{i % 11 if i % 5 else i}" + LONG[:300],
    "none": lambda i: None,
    "empty": lambda i: "" if i % 2 else "=",
}


@pytest.mark.parametrize("tracked, candidates", [(4096, 256), (64, 24)])
def test_top_values_against_brute_force(spark, monkeypatch, tracked, candidates):
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    monkeypatch.setattr(frequent, "CANDIDATES", candidates)
    data = [[f(i) for f in COLUMNS.values()] for i in range(4000)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in COLUMNS)).repartition(7)
    got = {}
    for r in D.categorical_top10(df).orderBy("column_name", "rank").collect():
        got.setdefault(r["column_name"], []).append((r["rank"], r["value"], r["count"]))
    for k, c in enumerate(COLUMNS):
        assert got.get(c, []) == slow_top([row[k] for row in data], 10), c


def test_very_long_values_and_no_rows(spark):
    df = spark.createDataFrame([(LONG + "b",), (LONG + "a",), (LONG + "b",), (LONG,), ("é",)], "t string")
    got = [(r["value"], r["count"]) for r in D.categorical_top10(df, n=2).orderBy("rank").collect()]
    assert got == [(LONG + "b", 2), (LONG, 1)]
    assert D.categorical_top10(df.limit(0)).count() == 0
    assert D.categorical_top10(df.select(F.length("t").alias("n"))).count() == 0


def test_only_unproven_columns_are_counted_whole(spark, monkeypatch):
    whole = []
    monkeypatch.setattr(frequent, "count_all", lambda df, name, n: whole.append(name) or df.sparkSession.createDataFrame(
        [], "column_name string, rank long, value string, count long"))
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS keys", "IF(id % 2 = 0, CAST(id % 20 AS STRING), 'tail' || id) AS skewed", "CAST(id % 9 AS STRING) AS few")
    assert D.categorical_top10(df).count() == 19 and whole == ["keys"]
