"""Property tests: exact quantiles (incl. the bracket-refinement path), correlation
bounds, approximate quantile rank error, clustering invariants."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prism.operators import correlate as C
from prism.operators import describe as D
from prism.operators import model as M
from prism.operators.quantiles import clean_columns, plan_exact_quantiles, quantile_columns


def _pandas_quantiles(values, probs):
    s = pd.Series(values, dtype=float).dropna()
    return [float(s.quantile(p)) if len(s) else None for p in probs]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6, allow_nan=False)), min_size=0, max_size=60))
def test_exact_quantiles_match_pandas_with_refinement(spark, values):
    vals = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in vals], "`a.b` double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    # a tiny leaf and a coarse sketch force the narrowing passes
    row = quantile_columns(plan_exact_quantiles(clean_columns(df, ["a.b"]), probs, leaf=2, k=8)).first()
    got = [row[f"p{i}"] for i in range(len(probs))]
    expect = _pandas_quantiles(vals, probs)
    for g, e in zip(got, expect):
        if e is None:
            assert g is None
        else:
            assert g == pytest.approx(e, rel=1e-12, abs=1e-9)


def test_describe_matches_pandas_on_skewed_data(spark):
    rng = np.random.default_rng(7)
    hot = np.full(4000, 3.0)  # one value holding a third of the rows
    x = np.concatenate([hot, rng.lognormal(size=8000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = D.describe_numeric(df, leaf=100).first()
    s = pd.Series(x)
    assert got["count"] == len(x)
    assert got["mean"] == pytest.approx(s.mean())
    assert got["std"] == pytest.approx(s.std())
    for name, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]:
        assert got[name] == pytest.approx(s.quantile(p), rel=1e-12)
    assert got["q25"] <= got["q50"] <= got["q75"]


def test_describe_narrows_wide_brackets(spark):
    """Many values and a small leaf: the inside of the brackets is sketched again, for names with dots too."""
    df = spark.range(0, 400_000, 1, 6).selectExpr("pmod(id * 7919, 399989) / 7D AS `a.b`", "CASE WHEN id % 3 = 0 THEN 5D ELSE rand(3) * 10 END AS `it's`",
                                                "IF(id = 7, NULL, exp(id % 1000 / 50)) AS x")
    got = {r["column_name"]: r for r in D.describe_numeric(df, leaf=20).collect()}
    pdf = df.toPandas()
    for c in df.columns:
        assert got[c]["count"] == pdf[c].count()
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert got[c][name] == pytest.approx(pdf[c].quantile(p), rel=1e-12), (c, name)
        assert got[c]["std"] == pytest.approx(pdf[c].std(), rel=1e-12) and got[c]["mean"] == pytest.approx(pdf[c].mean(), rel=1e-12)


def test_moments_of_far_values(spark):
    df = spark.range(0, 3000, 1, 200).selectExpr("1e9 + id % 7 AS x", "CAST(NULL AS DOUBLE) AS none", "IF(id = 5, 2D, NULL) AS one")
    got = {r["column_name"]: r for r in D.describe_numeric(df).collect()}
    assert got["x"]["std"] == pytest.approx(df.toPandas()["x"].std(), rel=1e-7)
    assert got["none"]["count"] == 0 and got["none"]["q50"] is None and got["none"]["mean"] is None
    assert got["one"]["q25"] == got["one"]["q75"] == 2.0 and got["one"]["std"] is None


def test_approx_quantiles_rank_error(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=20000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = D.describe_numeric_approx(df, accuracy=1000).first()
    xs = np.sort(x)
    for name, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]:
        rank = np.searchsorted(xs, got[name]) / len(xs)
        assert abs(rank - p) <= 2.0 / 1000 + 1e-9


def test_correlation_properties(spark, sf_dir):
    from prism.plans.q_stats import corr_frame
    m = C.correlation_matrix(corr_frame(spark, sf_dir)).collect()
    r = {(x["var1"], x["var2"]): x["r"] for x in m}
    for (a, b), v in r.items():
        assert -1.0 - 1e-12 <= v <= 1.0 + 1e-12
        assert v == pytest.approx(r[(b, a)])
    for v in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"]:
        assert r[(v, v)] == pytest.approx(1.0)
    assert r[("l_const", "l_const")] == 0.0 and r[("l_allnull", "l_allnull")] == 0.0
    assert r[("l_extendedprice", "l_net")] > 0.9


def test_kmeans_invariants(spark, sf_dir):
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = cust.count()
    costs = []
    for k in (2, 3, 4):
        res = M.kmeans(cust, ["c_acctbal", "c_nationkey"], k=k)
        prof = res.profile.collect()
        assert sum(p["size"] for p in prof) == n
        assert sum(p["pct"] for p in prof) == pytest.approx(100.0)
        assert res.centroids == sorted(res.centroids)
        costs.append(res.inertia)
    assert costs[0] >= costs[1] >= costs[2] * 0.999


def test_shares_sum_to_100(spark, sf_dir):
    from prism.operators.quality import complete_rows
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert complete_rows(li).first()["pct"] == pytest.approx(100.0)
