"""Physical-plan properties the scale design relies on (read from ``explain``)."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from prism.operators import correlate


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q(spark, sf_dir):
    def plan(name):
        spark.catalog.clearCache()  # cached relations from other tests would replace the scans
        return plan_of(E.queries()[name](spark, sf_dir))
    return plan


def test_top_k_per_group_limits_before_the_shuffle(q):
    for name in ("recent_per_owner", "similar_items", "activity_feed"):
        p = q(name)
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_no_pairs_of_a_group(q):
    for name in ("similar_items", "related_items", "related_items_lookup"):
        p = q(name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_only_the_preset_list_is_nested_loop_broadcast(q):
    assert "BroadcastNestedLoopJoin" in q("preset_eligibility")


def test_filters_and_projections_reach_the_scan(q):
    p = q("join_owner_filter")
    assert "EqualTo(o_custkey,7)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "GreaterThanOrEqual(ts," in q("filter_since")
    p = q("workspace_counts")
    assert "ReadSchema: struct<l_orderkey:bigint>" in p


def test_children_aggregated_before_joining(q):
    p = q("session_rollup")
    join_at = p.index("Join")
    assert "HashAggregate" in p[join_at:], "the child side is aggregated below the join"


def test_describe_final_pass_is_filtered(q):
    p = q("describe_numeric")
    assert "Filter" in p and "ObjectHashAggregate" in p


def test_correlation_of_many_columns_is_not_one_method(spark):
    """Whole-stage code of many columns is one method, which the JVM does not compile when it is long."""
    df = spark.range(100).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id") * i % 7).alias(f"w{i}") for i in range(30)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such a plan shows its whole-stage code at once
    try:
        plan = correlate.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    wide = [line for line in plan if "Project" in line and line.count("CASE WHEN") > 20]
    assert len(wide) == 1 and "*(" not in wide[0].split("Project")[0]
