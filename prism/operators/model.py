"""Modelling operators (M1-M8), distributed as DataFrame aggregates and blockwise factorisations. Statistics that parametrise a projection (means, deviations,
centroids, coefficients) are one-row results, inlined as literals: no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.sqltext import column, dlit, q
from prism.functions.missing import clean_numeric
from prism.operators.quality import drop_missing
from prism.operators.roles import roles
from prism.operators.working import working_set

MIN_REGRESSION_ROWS = 5
K_RANGE = (2, 20)
DEFAULT_K = 3


# ---------------------------------------------------------------- regression
def regression_prep(df: DataFrame, target: str | None, features: list[str] | None,
                    min_rows: int = MIN_REGRESSION_ROWS) -> DataFrame:
    """M1: numeric features + target with NaN -> NULL, listwise deletion.
    Raises with a stable code for missing parameters, target among features,
    non-numeric columns or fewer than ``min_rows`` complete rows."""
    return _prepare(df, target, features, min_rows)[0]


def _prepare(df: DataFrame, target: str | None, features: list[str] | None,
             min_rows: int = MIN_REGRESSION_ROWS) -> tuple[DataFrame, int]:
    if not target or not features:
        raise ValueError("missing_target_or_features")
    if target in features:
        raise ValueError("target_in_features")
    num = set(roles(df).numeric)
    bad = [c for c in [target, *features] if c not in num]
    if bad:
        raise ValueError(f"non_numeric_columns:{', '.join(bad)}")
    keep = [column(c) for c in df.columns if c not in [target, *features]]
    prepared = drop_missing(
        df.select(*keep, *[clean_numeric(c).alias(c) for c in features], clean_numeric(target).alias(target)),
        [target, *features])
    n = prepared.count()
    if n < min_rows:
        raise ValueError(f"too_few_rows:{n}")
    return prepared, n


def train_test_split(df: DataFrame, key_expr: Column | None = None, test_mod: int = 5,
                     key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: deterministic split -- ``pmod(key, test_mod) = 0`` is the test share
    (20 % for 5). The default key is ``xxhash64`` of ``key_cols`` (all columns)."""
    if key_expr is None:
        key_expr = F.xxhash64(*[column(c) for c in (key_cols or df.columns)])
    is_test = F.pmod(key_expr, F.lit(test_mod)) == 0
    return df.where(~is_test), df.where(is_test)


@dataclass
class RegressionResult:
    coefficients: DataFrame  # (term, coefficient)
    metrics: DataFrame       # (r2, mse, n_test)
    model: object
    n_samples: int


#: Partial factors that one task merges.
FACTORS = 64


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangle R of a block of rows: R'R = rows'rows."""
    return np.linalg.qr(rows, mode="r")


def _factor_row(group: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "height": pa.array([r.shape[0]], pa.int32()),
                                       "cells": pa.array([r.reshape(-1)], pa.list_(pa.float64()))})


def _factors(means: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
                r = _factor(rows if r is None else np.concatenate([r, rows]))
        if r is not None:
            yield _factor_row(TaskContext.get().partitionId() // FACTORS, r)

    return run


def _stacked(rows: pa.Table, width: int) -> np.ndarray:
    return rows["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class LinearModel:
    coefficients: list[float]
    intercept: float
    rank: int


def linear_regression(train: DataFrame, target: str, features: list[str]) -> LinearModel:
    """M3: least squares with intercept; among the solutions of collinear features the one of least norm, as
    sklearn's. Tasks reduce their centred rows to triangles by blockwise QR, which are merged ``FACTORS`` at a time; the
    singular values of the last one (features squared numbers) reveal the rank."""
    width = len(features) + 1
    work = train.selectExpr(*[f"CAST({q(c)} AS DOUBLE) AS c{i}" for i, c in enumerate([*features, target])])
    facts = work.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in work.columns]).first()
    if not facts["n"]:
        raise ValueError("too_few_rows:0")
    means = [facts[c] for c in work.columns]

    def merged(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_factor_row(0, _factor(_stacked(rows, width)))]).select(["height", "cells"])

    schema = "height int, cells array<double>"
    parts = work.mapInArrow(_factors(means), "part long, " + schema).groupBy("part").applyInArrow(merged, schema)
    r = _factor(_stacked(parts.toArrow(), width))
    solution, _, rank, _ = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=np.finfo(float).eps * max(width, facts["n"] ** 0.5) * 10)
    return LinearModel(solution.tolist(), means[-1] - float(np.dot(solution, means[:-1])), int(rank))


def coefficient_table(spark, model, features: list[str]) -> DataFrame:
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients)] + [("intercept", float(model.intercept))]
    return spark.createDataFrame(rows, "term string, coefficient double")


def prediction_expr(coefs: dict[str, float], intercept: float) -> Column:
    e = F.lit(float(intercept))
    for f, c in coefs.items():
        e = e + column(f) * F.lit(float(c))
    return e


def regression_eval(test: DataFrame, target: str, coefs: dict[str, float], intercept: float) -> DataFrame:
    """M4: (r2, mse, n_test) on the test split, one distributed aggregate
    (R^2 = 1 - SS_res / SS_tot around the test mean, as sklearn)."""
    pred = prediction_expr(coefs, intercept)
    y = column(target)
    s = test.select(y.alias("y"), ((y - pred) * (y - pred)).alias("se")).agg(
        F.sum("se").alias("ss_res"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"))
    return s.select(
        (F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("v") * F.col("n"))).alias("r2"),
        F.try_divide(F.col("ss_res"), F.col("n")).alias("mse"),
        F.col("n").alias("n_test"))


def regression_analysis(df: DataFrame, target: str, features: list[str], key_expr: Column | None = None) -> RegressionResult:
    """M1 -> M2 -> M3 -> M4. Each pass is one cheap scan (the normal-equation
    fit aggregates X'X in one pass), so the input is re-scanned, not cached."""
    prepared, n = _prepare(df, target, features)
    train, test = train_test_split(prepared, key_expr)
    model = linear_regression(train, target, features)
    coefs = dict(zip(features, [float(c) for c in model.coefficients]))
    metrics = regression_eval(test, target, coefs, float(model.intercept))
    return RegressionResult(coefficient_table(df.sparkSession, model, features), metrics, model, n)


# ---------------------------------------------------------------- clustering
def scale_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of each column (one aggregate, one row)."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(column(c)).alias(f"m{i}"), F.stddev_pop(column(c)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: list[str], stats: dict[str, tuple[float, float]] | None = None,
                   suffix: str = "") -> DataFrame:
    """M5: z-score with the *population* std (sklearn); a zero std divides by 1."""
    stats = stats or scale_stats(df, cols)
    out = [column(c) for c in df.columns if suffix or c not in cols]
    for c in cols:
        m, s = stats[c]
        s = s if s not in (None, 0.0) else 1.0
        out.append(((column(c) - F.lit(m)) / F.lit(s)).alias(f"{c}{suffix}"))
    return df.select(*out)


def nearest_centroid_expr(cols: list[str], centroids: list[list[float]]) -> Column:
    """struct(dist2, cluster) of the closest centroid (squared Euclidean distance, ties to the lower index)."""
    parts = []
    for i, centroid in enumerate(centroids):
        terms = " + ".join(f"({q(c)} - {dlit(v)}) * ({q(c)} - {dlit(v)})" for c, v in zip(cols, centroid))
        parts.append(f"named_struct('dist2', {terms}, 'cluster', {i})")
    return F.expr(f"array_min(array({', '.join(parts)}))")


def nearest_centroid(df: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """M8: assign each row to its closest centroid -> columns ``cluster`` and ``dist2``."""
    return df.withColumn("__best", nearest_centroid_expr(cols, centroids)).select(
        *[column(c) for c in df.columns], F.col("__best.cluster").alias("cluster"), F.col("__best.dist2").alias("dist2"))


@dataclass
class ClusterResult:
    assigned: DataFrame   # input columns + scaled + cluster + dist2
    profile: DataFrame    # (cluster, size, pct, mean_<col>...)
    inertia: float
    centroids: list[list[float]]
    k: int


def farthest_first(points: DataFrame, k: int) -> list[list[float]]:
    """k starting centres: the point farthest from the mean of scaled points, then each time the one
    farthest from those chosen (ties: the greatest values). One aggregate a centre."""
    zero, own = [0.0] * len(points.columns), F.struct(*points.columns)
    chosen: list[list[float]] = []
    for _ in range(k):
        apart = F.round(nearest_centroid_expr(points.columns, chosen or [zero])["dist2"], 9)
        chosen.append([float(v) for v in points.agg(F.max_by(own, F.struct(apart, own)).alias("p")).first()["p"]])
    return chosen


def kmeans(df: DataFrame, cols: list[str] | None = None, k: int | None = DEFAULT_K, max_iter: int = 50,
           tol: float = 1e-4) -> ClusterResult:
    """M6: k-means on standard-scaled numeric columns, from the centres of :func:`farthest_first`, so it gives the same
    result each time; it ends after ``max_iter`` rounds or when the centres move by at most ``tol`` (sum of squares). Labels
    are canonicalised by sorting the centres; a centre without points stays. The rounds read a table of the scaled
    numbers alone; ``assigned`` keeps all input
    columns of the complete rows and adds the scaled columns, ``cluster`` and ``dist2``."""
    k = DEFAULT_K if k in (None, "") else int(k)
    if not (K_RANGE[0] <= k <= K_RANGE[1]):
        raise ValueError(f"k_out_of_range:{k}")
    cols = list(cols) if cols else roles(df).numeric
    if len(cols) < 2:
        raise ValueError("too_few_numeric_for_clustering")
    data = drop_missing(df.select(*[clean_numeric(c).alias(c) if c in cols else column(c) for c in df.columns]), cols)
    facts = data.agg(F.count(F.lit(1)).alias("n")).first()
    if facts["n"] < k:
        raise ValueError(f"too_few_rows_for_k:{facts['n']}")
    scaled_names = [f"{c}__z" for c in cols]
    scaled = standard_scale(data, cols, scale_stats(data, cols), suffix="__z")
    points = working_set(scaled.select(*[column(c).alias(f"z{i}") for i, c in enumerate(scaled_names)]))
    centres = farthest_first(points, k)
    for _ in range(max_iter):
        means = (points.groupBy(nearest_centroid_expr(points.columns, centres)["cluster"].alias("cluster"))
                 .agg(*[F.avg(c).alias(c) for c in points.columns]).collect())
        moved = [list(c) for c in centres]
        for r in means:
            moved[r["cluster"]] = [r[c] for c in points.columns]
        shift = sum((a - b) ** 2 for old, new in zip(centres, moved) for a, b in zip(old, new))
        centres = moved
        if shift <= tol:
            break
    centres = sorted(centres)
    inertia = float(points.agg(F.sum(nearest_centroid_expr(points.columns, centres)["dist2"])).first()[0])
    points.unpersist()
    assigned = nearest_centroid(scaled, scaled_names, centres)
    return ClusterResult(assigned, cluster_profile(assigned, "cluster", cols), inertia, centres, k)


def cluster_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """M7: (cluster, size, pct, mean_<col>) -- means of the *unscaled* columns.
    The share uses a window over the k result rows (k <= 20)."""
    g = df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(column(c)).alias(f"mean_{c}") for c in cols])
    return g.select("cluster", "size", (F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy())).alias("pct"),
                    *[column(f"mean_{c}") for c in cols])
