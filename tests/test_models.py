"""Least squares of least norm, deterministic k-means, and names with dots through every model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prism.operators import charts as CH
from prism.operators import model as M
from prism.plans.analysis import run_analysis
from prism.sources import sinks as S

ODD = ["a.b", "it's", "back`tick"]


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"a.b": x[:, 0] + 3 * (x[:, 1] > 0), "it's": x[:, 1] * 5, "back`tick": 2 * x[:, 0] - x[:, 1] + rng.normal(size=n), "k.y": range(n)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def least_squares(x, y):
    b = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    return b, y.mean() - b @ x.mean(0)


def test_names_with_dots_through_every_model(spark):
    df, pdf = frame(spark)
    res = M.regression_analysis(df, "back`tick", ["a.b", "it's"])
    assert res.metrics.first()["r2"] > 0.5 and res.coefficients.count() == 3
    train, test = M.train_test_split(df)
    assert train.count() + test.count() == 400 and 0 < test.count() < 200
    z = M.standard_scale(df, ODD, suffix=".z")
    assert z.agg(F.avg("`a.b.z`")).first()[0] == pytest.approx(0, abs=1e-9)
    clusters = M.kmeans(df, ODD, k=3)
    assert clusters.assigned.columns[:4] == df.columns and "mean_a.b" in clusters.profile.columns
    assert clusters.profile.agg(F.sum("size")).first()[0] == 400
    near = M.nearest_centroid(df, ["a.b", "it's"], [[0.0, 0.0], [3.0, 0.0]])
    assert near.where("cluster = 1").count() == sum(((pdf["a.b"] - 3) ** 2 < pdf["a.b"] ** 2))
    assert '"a.b":' in S.results_json(df, "k.y").first()["document"]
    assert CH.chart_scatter_sample(df, "a.b", "it's", F.xxhash64("`k.y`"), 50).count() == 50
    for kind, params in (("regression", {"target_column": "back`tick", "feature_columns": ["a.b", "it's"]}), ("clustering", {"columns": ODD})):
        done = run_analysis(df, kind, params)
        assert done.status == "completed", done.error


@pytest.mark.parametrize("n", [7, 3000])
def test_regression_of_least_norm(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    x = np.column_stack([x, x[:, 0] - 2 * x[:, 2], np.full(n, 4.0)])  # a dependent and a constant column
    y = x @ [1, 0.5, 30, 0, 0] + rng.normal(size=n) * 0.1
    names = [f"x.{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(6)
    model = M.linear_regression(df, "y", names)
    b, a = least_squares(x, y)
    assert model.rank == 3
    assert model.coefficients == pytest.approx(b.tolist(), rel=1e-6, abs=1e-8) and model.intercept == pytest.approx(a, rel=1e-6)


def test_regression_on_twice_a_feature(spark):
    df = spark.range(0, 50, 1, 4).selectExpr("CAST(id AS DOUBLE) AS x", "2D * id AS x2", "3D * id + 1 AS y")
    model = M.linear_regression(df, "y", ["x", "x2"])
    assert model.coefficients == pytest.approx([0.6, 1.2]) and model.intercept == pytest.approx(1.0) and model.rank == 1
    with pytest.raises(ValueError, match="too_few_rows:0"):
        M.linear_regression(df.limit(0), "y", ["x"])


def slow_kmeans(z, k, max_iter, tol):
    chosen = []
    for _ in range(k):
        apart = ((z[:, None] - np.array(chosen or [[0.0] * z.shape[1]])) ** 2).sum(2).min(1).round(9)
        chosen.append(z[max(range(len(z)), key=lambda i: (apart[i], *z[i]))].tolist())
    centres = np.array(chosen)
    for _ in range(max_iter):
        near = ((z[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([z[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= tol:
            break
    return sorted(centres.tolist())


def test_kmeans_against_brute_force_and_reruns(spark):
    df, pdf = frame(spark)
    pdf = pdf[ODD]
    res = M.kmeans(df, ODD, k=4)
    z = ((pdf - pdf.mean()) / pdf.std(ddof=0)).to_numpy()
    assert np.allclose(res.centroids, slow_kmeans(z, 4, 50, 1e-4), atol=1e-9)
    again = M.kmeans(df.repartition(2), ODD, k=4)
    assert np.allclose(again.centroids, res.centroids, atol=1e-9) and again.inertia == pytest.approx(res.inertia)


def test_kmeans_of_equal_points(spark):
    df = spark.createDataFrame([(1.0, 2.0, "t")] * 6, "a double, b double, t string")
    res = M.kmeans(df, ["a", "b"], k=3)
    assert res.inertia == 0 and [(r["cluster"], r["size"]) for r in res.profile.collect()] == [(0, 6)]


def test_kmeans_caches_numbers_alone(spark):
    df, _ = frame(spark)
    res = M.kmeans(df.withColumn("text", F.repeat(F.lit("x"), 1000)), ["a.b", "it's"], k=2)
    plan = res.assigned._jdf.queryExecution().executedPlan().toString()
    assert "InMemory" not in plan and res.assigned.count() == 400
