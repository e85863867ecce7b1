"""Pairwise correlation.

Pearson r with pairwise deletion: for each pair only rows where both values are
present count, and a pair without variance in its overlap gives 0 (the
reference fills NaN with 0). Tasks sum blocks of moments; the matrix itself has
(#columns)^2 rows.
``F.corr`` is avoided: it raises on a zero variance under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.sqltext import clean_double, column, q
from prism.operators.roles import roles


def _clean(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.selectExpr(*[f"{clean_double(c)} AS {q(c)}" for c in cols])


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A7 facts: (pos, column_name, n, is_constant). A column is constant when it
    has >= 2 values and min = max (pandas: variance 0; fewer values give NaN
    variance, which the reference keeps)."""
    cols = list(cols) if cols is not None else roles(df).numeric
    work = _clean(df, cols)
    one = work.agg(*[x for i, c in enumerate(cols) for x in
                     (F.count(q(c)).alias(f"n{i}"), F.min(q(c)).alias(f"mn{i}"), F.max(q(c)).alias(f"mx{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(
            F.lit(i + 1).alias("pos"),
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("n"),
            ((F.col(f"n{i}") >= 2) & (F.col(f"mn{i}") == F.col(f"mx{i}"))).alias("is_constant"),
        )
        for i, c in enumerate(cols)
    ])))


def drop_constant_columns(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, int, list[str]]:
    """(frame of the variable numeric columns, number removed, kept names).
    Collects one row per column (bounded by the schema, not the data)."""
    facts = constant_columns(df, cols).orderBy("pos").collect()
    kept = [r["column_name"] for r in facts if not r["is_constant"]]
    return df.select(*map(q, kept)), len(facts) - len(kept), kept


#: A pair whose sum of squares falls below this share when it is centred on its overlap is centred again by itself.
CANCELLED = 1e-6


def _pair_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of every ordered pair (i, j) over the rows of ``x`` (NaN: missing) that have both
    values: n, and of column i its mean, centred sum of squares, least and greatest; and the
    centred cross products. All pairs are block products of the columns around their own means;
    pairs that this leaves badly conditioned (an overlap far from the mean, a constant) are done again one by one."""
    there = ~np.isnan(x)
    own = there.sum(0)
    centre = np.where(own > 0, np.where(there, x, 0).sum(0) / np.maximum(own, 1), 0)
    around, mask = np.where(there, x - centre, 0), there.astype(float)
    n, s, q, c = mask.T @ mask, around.T @ mask, (around * around).T @ mask, around.T @ around
    some = np.maximum(n, 1)
    m = {"n": n, "mean": centre[:, None] + s / some, "square": q - s * s / some, "cross": c - s * s.T / some,
         "least": np.broadcast_to(np.where(there, x, np.inf).min(0)[:, None], n.shape).copy(),
         "most": np.broadcast_to(np.where(there, x, -np.inf).max(0)[:, None], n.shape).copy()}
    again = (n > 0) & ~(m["square"] > CANCELLED * q)
    for i, j in zip(*np.nonzero(np.triu(again | again.T))):
        rows = there[:, i] & there[:, j]
        a, b = x[rows, i], x[rows, j]
        d, e = a - a.mean(), b - b.mean()
        m["cross"][i, j] = m["cross"][j, i] = d @ e
        for at, values, apart in (((i, j), a, d), ((j, i), b, e)):
            m["mean"][at], m["square"][at] = values.mean(), apart @ apart
            m["least"][at], m["most"][at] = values.min(), values.max()
    for name, value in (("mean", 0), ("square", 0), ("cross", 0), ("least", np.inf), ("most", -np.inf)):
        m[name][n == 0] = value
    return m


def _merge(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of two sets of rows together (pairwise update of means and co-moments)."""
    n = a["n"] + b["n"]
    share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    apart, weight = b["mean"] - a["mean"], a["n"] * share
    return {"n": n, "mean": a["mean"] + apart * share, "square": a["square"] + b["square"] + apart * apart * weight,
            "cross": a["cross"] + b["cross"] + apart * apart.T * weight,
            "least": np.minimum(a["least"], b["least"]), "most": np.maximum(a["most"], b["most"])}


#: What is kept of a pair (i, j), i <= j; 1 and 2 are its first and second column.
MOMENTS = ["n", "mean1", "mean2", "square1", "square2", "cross", "least1", "most1", "least2", "most2"]
#: Pairs of one shuffled row, and tasks whose rows are merged first (about the square root of a large scan's tasks).
TILE, FAN = 4_096, 512


def _partition_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(values) -> a task's moments: one row for each tile of pairs, its moments one after the other."""
    held = None
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            own = _pair_moments(x)
            held = own if held is None else _merge(held, own)
    if held is not None:
        i, j = np.triu_indices(len(held["n"]))
        m = np.stack([held["n"][i, j], held["mean"][i, j], held["mean"][j, i], held["square"][i, j], held["square"][j, i],
                      held["cross"][i, j], held["least"][i, j], held["most"][i, j], held["least"][j, i], held["most"][j, i]])
        group = TaskContext.get().partitionId() // FAN
        for tile in range(0, len(i), TILE):
            yield _tile_row(group, tile, m[:, tile:tile + TILE])


def _tile_row(group: int, tile: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "tile": pa.array([tile], pa.int64()),
                                       "moments": pa.array([m.reshape(-1)], pa.list_(pa.float64()))})


def _merge_tile(rows: pa.Table) -> np.ndarray:
    """The moments of all rows of a tile together (pairwise update of means and co-moments)."""
    parts = rows["moments"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(MOMENTS), -1)
    out = {k: v for k, v in zip(MOMENTS, parts[0])}
    for part in parts[1:]:
        b = dict(zip(MOMENTS, part))
        n = out["n"] + b["n"]
        share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
        weight, apart = out["n"] * share, [b[f"mean{k}"] - out[f"mean{k}"] for k in "12"]
        out["cross"] = out["cross"] + b["cross"] + apart[0] * apart[1] * weight
        for k, d in zip("12", apart):
            out[f"mean{k}"] = out[f"mean{k}"] + d * share
            out[f"square{k}"] = out[f"square{k}"] + b[f"square{k}"] + d * d * weight
            out[f"least{k}"], out[f"most{k}"] = np.minimum(out[f"least{k}"], b[f"least{k}"]), np.maximum(out[f"most{k}"], b[f"most{k}"])
        out["n"] = n
    return np.stack([out[k] for k in MOMENTS])


def _merged(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_tile_row(0, rows["tile"][0].as_py(), _merge_tile(rows))]).select(["tile", "moments"])


def _coefficients(columns: int):
    def run(rows: pa.Table) -> pa.Table:
        m = dict(zip(MOMENTS, _merge_tile(rows)))
        varies = (m["n"] > 0) & (m["least1"] < m["most1"]) & (m["least2"] < m["most2"])
        scale = np.sqrt(np.where(varies, m["square1"], 1)) * np.sqrt(np.where(varies, m["square2"], 1))
        r = np.divide(m["cross"], scale, out=np.zeros_like(scale), where=varies & (scale > 0))
        i, j = (k[rows["tile"][0].as_py():][:len(r)] for k in np.triu_indices(columns))
        r = np.where(np.isnan(r), 0, np.clip(r, -1, 1))
        r = np.where((i == j) & (r > 0), 1.0, r)
        # both orders of a pair, the diagonal once
        apart = i != j
        return pa.table({"i": np.concatenate([i, j[apart]]), "j": np.concatenate([j, i[apart]]), "r": np.concatenate([r, r[apart]])})

    return run


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(pos1, var1, pos2, var2, r) for every ordered pair incl. the diagonal.

    One scan: each task sums the moments of all pairs over its rows as blocks (columns
    squared numbers, whatever the rows), every pair centred on its own overlap. They are merged in a tree, tile by tile
    of pairs: first the rows of ``FAN`` tasks, then those; a shuffled row holds a tile's moments.
    A pair whose overlap holds one distinct value of either column has r = 0.
    """
    cols = list(cols) if cols is not None else roles(df).numeric
    if not cols:
        return df.sparkSession.createDataFrame([], "pos1 int, var1 string, pos2 int, var2 string, r double")
    # The second column keeps the projection (and what it is merged with) out of whole-stage code, as higher-order functions have
    # none: that would be one method for all columns, and the JVM never compiles methods beyond 8,000 bytes. NaN is missing anyway.
    values = df.select(F.array(*[column(c).cast("double") for c in cols]).alias("x"),
                       F.transform(F.array(F.spark_partition_id()), lambda part: part).alias("part"))
    # a row of missing values adds nothing, but where there are no rows it makes the pairs (with r = 0)
    none = df.sparkSession.range(1).select(F.array(*[F.lit(None).cast("double") for _ in cols]).alias("x"), F.array(F.lit(0)).alias("part"))
    parts = values.unionByName(none).mapInArrow(_partition_moments, "part long, tile long, moments array<double>")
    tiles = parts.groupBy("part", "tile").applyInArrow(_merged, "tile long, moments array<double>")
    found = tiles.groupBy("tile").applyInArrow(_coefficients(len(cols)), "i long, j long, r double")
    names = F.array(*map(F.lit, cols))
    return found.select((F.col("i") + 1).cast("int").alias("pos1"), F.get(names, F.col("i").cast("int")).alias("var1"),
                        (F.col("j") + 1).cast("int").alias("pos2"), F.get(names, F.col("j").cast("int")).alias("var2"), "r")


def top_correlations(matrix: DataFrame, n: int = 10) -> DataFrame:
    """(rank, var1, var2, r) -- upper-triangle pairs by |r| desc; ties keep the
    matrix order, as Python's stable sort does. The matrix is (#columns)^2 rows."""
    order = [F.abs(F.col("r")).desc(), F.col("pos1"), F.col("pos2")]
    top = matrix.where(F.col("pos1") < F.col("pos2")).orderBy(*order).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "var1", "var2", "r")


@dataclass
class CorrelationResult:
    matrix: DataFrame
    top: DataFrame
    summary: DataFrame
    kept: list[str]
    removed: int


def correlation_analysis(df: DataFrame, n: int = 10) -> CorrelationResult:
    """A7 -> A8 -> A9 -> A10, raising with a stable code when too few columns."""
    num = roles(df).numeric
    if len(num) < 2:
        raise ValueError(f"too_few_numeric:{len(num)}")
    _, removed, kept = drop_constant_columns(df, num)
    if len(kept) < 2:
        raise ValueError(f"too_few_variable_columns:{', '.join(kept)}")
    matrix = correlation_matrix(df, kept)
    top = top_correlations(matrix, n)
    summary = correlation_summary_from(top, len(kept), len(num), kept)
    return CorrelationResult(matrix, top, summary, kept, removed)


def correlation_summary_from(top: DataFrame, analysed: int, original: int, kept: list[str]) -> DataFrame:
    s = top.agg(F.min_by(F.struct("var1", "var2", "r"), "rank").alias("s"))
    return s.select(
        F.lit(analysed).cast("bigint").alias("variables_analyzed"),
        F.lit(original).cast("bigint").alias("original_numeric_columns"),
        F.lit(original - analysed).cast("bigint").alias("removed_constant_columns"),
        F.col("s.var1").alias("strongest_var1"),
        F.col("s.var2").alias("strongest_var2"),
        F.col("s.r").alias("strongest_r"),
        F.lit(", ".join(kept)).alias("analyzed_columns"),
    )


def correlation_summary(df: DataFrame) -> DataFrame:
    """A10: one row: variables analysed, original numeric count, removed, strongest pair, columns."""
    return correlation_analysis(df).summary
