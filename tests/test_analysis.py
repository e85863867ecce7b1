"""run_analysis end to end on the driver tables: every analysis type."""

import pytest
from pyspark.sql import functions as F

from prism.plans.analysis import run_analysis
from prism.plans.fixtures import lineitem_nulls


def test_descriptive(spark, sf_dir):
    res = run_analysis(lineitem_nulls(spark, sf_dir), "descriptive")
    assert res.status == "completed", res.error
    summary = res.tables["summary"].first()
    assert summary["numeric_columns"] == 8 and summary["categorical_columns"] == 2
    stats = {r["column_name"]: r for r in res.tables["numeric_stats"].collect()}
    assert stats["l_tax"]["count"] < summary["total_rows"]
    charts = {r["chart"] for r in res.charts.select("chart").distinct().collect()}
    assert {"composition", "five_number", "median_vs_mean", "completeness"} <= charts
    assert any(c.startswith("category:") for c in charts)


def test_correlation(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    res = run_analysis(li, "correlation")
    assert res.status == "completed", res.error
    top = res.tables["strong_correlations"].orderBy("rank").first()
    assert {top["var1"], top["var2"]} == {"l_extendedprice", "net"}
    assert res.tables["summary"].first()["variables_analyzed"] == 4


def test_regression(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    res = run_analysis(li, "regression", {"target_column": "net", "feature_columns": ["l_extendedprice", "l_discount"],
                                          "split_key": F.col("l_orderkey") * 7 + F.col("l_linenumber")})
    assert res.status == "completed", res.error
    m = res.tables["metrics"].first()
    assert 0.9 < m["r2"] <= 1.0 and m["n_samples"] == li.count()
    coefs = {r["term"]: r["coefficient"] for r in res.tables["coefficients"].collect()}
    assert coefs["l_extendedprice"] == pytest.approx(0.95, abs=0.02)
    bad = run_analysis(li, "regression", {"target_column": "l_tax", "feature_columns": ["l_tax"]})
    assert bad.status == "failed" and bad.error == "target_in_features"


def test_clustering(spark, sf_dir):
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    res = run_analysis(cust, "clustering", {"columns": ["c_acctbal", "c_nationkey"], "n_clusters": 4})
    assert res.status == "completed", res.error
    prof = res.tables["clusters"].collect()
    assert len(prof) == 4 and sum(p["size"] for p in prof) == cust.count()


def test_timeseries(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    res = run_analysis(ev, "timeseries", {"date_column": "ts", "value_column": "value"})
    row = res.tables["summary"].first()
    assert res.status == "completed" and row["n_observations"] == ev.count() and row["message"] is None
    missing = run_analysis(ev, "timeseries", {})
    assert missing.tables["summary"].first()["message"] == "missing_parameters"


def test_the_callers_cache_survives_and_bad_parameters_fail_cleanly(spark, sf_dir):
    df = lineitem_nulls(spark, sf_dir).select("l_quantity", "l_tax", "l_shipdate").cache()
    df.count()
    run_analysis(df, "descriptive")
    assert run_analysis(df, "timeseries", {"date_column": "no such", "value_column": "l_tax"}).status == "failed"
    assert df.storageLevel.useMemory
    df.unpersist()
