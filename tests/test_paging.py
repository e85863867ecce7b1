"""Pages by key equal pages by offset, for ascending, descending and null values."""

import pytest
from pyspark.sql import functions as F

from prism.operators import listing as L


@pytest.mark.parametrize("order", [["a", "b", "id"], ["-a", "b", "id"], ["a", "-b", "-id"], ["-a", "-b", "id"], ["-id"]])
def test_pages_by_key(spark, order):
    rows = [(None if i % 5 == 0 else float(i % 4), None if i % 3 == 0 else f"t{i % 2}", i) for i in range(41)]
    df = spark.createDataFrame(rows, "a double, b string, id long").repartition(3)
    whole = L.sort_allowlist(df, None, [], order, []).collect()
    after, seen = None, []
    while page := L.page_after(df, order, after, 7).collect():
        seen += page
        after = [page[-1][c.removeprefix("-")] for c in order]
    assert seen == whole and len(seen) == 41


def test_order_of_a_list():
    assert L.sort_order("-x", ["x"], ["-y"], ["id"]) == ["-x", "id"]
    assert L.sort_order("z", ["x"], ["-id"], ["id"]) == ["-id"]
    assert L.sort_order(None, ["x"], ["-y"], ["a", "id"]) == ["-y", "a", "id"]


def test_no_offset_in_a_deep_page(spark):
    df = spark.range(1000).select(F.col("id").alias("a.b"), (F.col("id") % 7).alias("k"))
    deep = L.page_after(df, ["-k", "a.b"], [3, 500], 5)
    assert "Offset" not in deep._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in deep.collect()] == [(x, 3) for x in range(501, 1000) if x % 7 == 3][:5]
