"""Hot keys: one owner / parent / value holding a third of all rows must give the
same answers as a brute-force computation (no caps, no dropped rows)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prism.operators import describe as D
from prism.operators import joins as J
from prism.operators import listing as L
from prism.operators import workspace as WS


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(3000):
        owner = 0 if i % 3 == 0 else i % 97 + 1          # owner 0 holds a third of the rows
        kind = "hot" if i % 3 == 0 else f"k{i % 11}"
        rows.append((i, owner, kind, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", float(i % 7)))
    df = spark.createDataFrame(rows, "id bigint, owner bigint, kind string, ts string, v double")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), pd.DataFrame(rows, columns=["id", "owner", "kind", "ts", "v"])


def test_similar_items_equals_brute_force(skewed):
    df, pdf = skewed
    got = {(r["id"], r["similar_id"], r["rank"]) for r in
           J.similar_items(df, ["owner", "kind"], "id", [F.col("ts").desc(), F.col("id").desc()], 4).collect()}
    pdf = pdf.assign(ts=pd.to_datetime(pdf["ts"]))
    expect = set()
    for _, g in pdf.groupby(["owner", "kind"]):
        g = g.sort_values(["ts", "id"], ascending=False)
        ids = list(g["id"])
        for x in ids:
            peers = [y for y in ids if y != x][:4]
            expect |= {(x, y, k + 1) for k, y in enumerate(peers)}
    assert got == expect


def test_related_counts_and_top_values_with_hot_key(skewed):
    df, pdf = skewed
    rel = {r["id"]: r["n_related"] for r in J.related_counts(df, "owner", ["id"]).collect()}
    sizes = pdf.groupby("owner")["id"].count()
    assert all(rel[i] == sizes[o] - 1 for i, o in zip(pdf["id"], pdf["owner"]))
    top = D.categorical_top10(df.select("kind")).orderBy("rank").collect()
    assert top[0]["value"] == "hot" and top[0]["count"] == 1000


def test_per_owner_rollups_with_hot_owner(skewed):
    df, pdf = skewed
    recent = L.recent_per_owner(df, "owner", "ts", ["id"], 5)
    assert recent.where(F.col("owner") == 0).count() == 5
    counts = {r["owner"]: r["n"] for r in WS.per_owner_counts(df, "owner", "n").collect()}
    assert counts[0] == 1000 and sum(counts.values()) == 3000


def test_describe_with_hot_value(skewed, spark):
    df, pdf = skewed
    row = D.describe_numeric(df.select("v"), leaf=10).first()
    s = pdf["v"]
    assert (row["q25"], row["q50"], row["q75"]) == tuple(float(s.quantile(p)) for p in (0.25, 0.5, 0.75))
