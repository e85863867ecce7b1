"""Embedding whitening by a bidiagonal qd solver.

Components become integers, ``floor(SCALE * c) + OFFSET``. The fit list is each distinct integer vector once,
written to the shared folder. Its covariance V is never formed: every task
reduces its centred rows to a triangle by blockwise QR, and the triangles are stacked and reduced again in a tree of
``FAN`` triangles a task, until one R with R'R = nV is left. What follows depends on the dimension alone:

* Householder reflections from both sides take R to an upper bidiagonal matrix B;
* dqds finds the eigenvalues of B'B, each to high relative accuracy, with shifts from Newton's bound
  (the inverse of the trace of the inverse), which never passes the smallest eigenvalue;
* for each wanted eigenvalue a twisted factorisation of B'B - eI, put together from a stationary and a progressive qd
  transform where the two meet best, gives the eigenvector, and the reflections take it back to a direction of V.
  Eigenvalues without a clear gap get orthogonal vectors by inverse iteration with the factorisation.

Rows are centred before anything is multiplied: the integers are reduced by the whole part of the mean, exactly, and
only then by its fraction.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; the dimension is that of the
smallest id's non-empty vector, and rows of another length, or with an integer component
beyond 2^50, take no part in the fit and come back with null deviation and null whitened values; a deviation beyond a long is null; directions whose
eigenvalue is zero to working precision are left out (one distinct vector has none, so there are no rows);
ids may be null or repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.session import cut_lineage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Partial results that one task merges; rows of a QR block.
FAN, BLOCK = 16, 4_096
EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer to each other than this share get vectors that are made orthogonal.
GAP = 1e-4


# --- the distributed reduction ----------------------------------------------------


def _tree(rows: DataFrame, tasks: int, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One matrix out of one a task (columns task, height, cells), FAN of them at a time."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        return _row(group["task"][0].as_py() // FAN, merge(_matrices(group)))

    rows = cut_lineage(rows, "whiten-parts")
    while tasks > 1:
        rows = rows.groupBy(F.floor(F.col("task") / FAN).alias("by")).applyInArrow(run, "task long, height int, cells array<double>")
        tasks = math.ceil(tasks / FAN)
    found = _matrices(rows.toArrow())
    return found[0] if found else None


def _row(task: int, a: np.ndarray) -> pa.Table:
    return pa.table({"task": pa.array([task], pa.int64()), "height": pa.array([a.shape[0]], pa.int32()),
                     "cells": pa.array([a.reshape(-1)], pa.list_(pa.float64()))})


def _matrices(rows: pa.Table) -> list[np.ndarray]:
    return [np.array(c.values if hasattr(c, "values") else c.as_py(), float).reshape(h, -1)
            for h, c in zip(rows["height"].to_pylist(), rows["cells"].combine_chunks())]


def _integers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


@dataclass
class Centre:
    """The mean as whole and fractional parts: S = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where a long does not hold it."""
        near = x - self.whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * max(x.shape[1], 1) < 2 ** 63:
            return (((self.n * near - self.rest) ** 2).sum(1)).tolist()
        exact = ((self.n * near.astype(object) - self.rest.astype(object)) ** 2).sum(1).tolist()
        return [d if d < 2 ** 63 else None for d in exact]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each dimension: rows and the sum of the component."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch["x"])
            n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({
            "place": pa.array(np.arange(len(total)), pa.int32()), "n": pa.array(np.full(len(total), n), pa.int64()),
            "s": pa.array(total, pa.int64())})


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _triangles(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _integers(batch["x"]) if batch.num_rows else np.zeros((0, 0))
            for i in range(0, len(x), BLOCK):
                rows = centre.of(x[i:i + BLOCK])
                r = _triangle(rows if r is None else np.concatenate([r, rows]))
        if r is not None:
            yield from _row(TaskContext.get().partitionId(), r).to_batches()

    return run


def _moments(model: Model):
    """Per task the count, means and co-moments of the whitened rows, as rows of one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                w = model.transform(_integers(batch["x"]))
                mean = w.mean(0)
                part = np.concatenate([np.full((1, w.shape[1]), float(len(w))), mean[None], (w - mean).T @ (w - mean)])
                own = part if own is None else _merge_moments([own, part])
        if own is not None:
            yield from _row(TaskContext.get().partitionId(), own).to_batches()

    return run


def _merge_moments(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for b in parts[1:]:
        n, m, shift = out[0, 0], b[0, 0], b[1] - out[1]
        moments = out[2:] + b[2:] + np.outer(shift, shift) * (n * m / (n + m))
        out = np.concatenate([np.full((1, len(shift)), n + m), (out[1] + shift * (m / (n + m)))[None], moments])
    return out


# --- the bidiagonal solver ----------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta, alpha: (I - beta v v') x = alpha e1."""
    norm, v = float(np.linalg.norm(x)), x.astype(float).copy()
    if norm == 0 or not np.any(x[1:]):
        return v, 0.0, float(x[0])
    alpha = -math.copysign(norm, x[0])
    v[0] -= alpha
    return v, 2 / float(v @ v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """Diagonal and superdiagonal of an upper bidiagonal B = U' r W, and the reflections that make W."""
    a, d = r.astype(float).copy(), r.shape[1]
    if a.shape[0] < d:
        a = np.concatenate([a, np.zeros((d - a.shape[0], d))])
    right = []
    for k in range(d):
        v, beta, alpha = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        a[k, k], a[k + 1:, k] = alpha, 0
        if k + 2 < d:
            v, beta, alpha = _reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, beta * v)
                right.append((k + 1, v, beta))
            a[k, k + 1], a[k, k + 2:] = alpha, 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def back(z: np.ndarray, right: list[tuple[int, np.ndarray, float]]) -> np.ndarray:
    """W z."""
    out = z.copy()
    for k, v, beta in reversed(right):
        out[k:] -= beta * v * (v @ out[k:])
    return out


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform with a shift, and the sum of 1/d; None where a d is not positive."""
    d, out_q, out_e, inverse = q[0] - shift, [], [], 0.0
    for i, off in enumerate(e):
        if d <= 0:
            return None
        inverse += 1 / d
        out_q.append(d + off)
        ratio = q[i + 1] / out_q[-1]
        out_e.append(off * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e, inverse + 1 / d if d > 0 else math.inf


def eigenvalues(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Eigenvalues of B'B in falling order, by dqds with deflation."""
    top = float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    if top == 0:
        return [0.0] * len(diagonal)
    # a diagonal entry of exactly zero would end the qd recurrences; below rounding it changes nothing
    q = [max(abs(float(a)) / top, EPS * EPS) ** 2 for a in diagonal]
    e = [(float(b) / top) ** 2 for b in above]
    done, blocks = [], [(q, e, 0.0)]
    negligible = (10 * EPS) ** 2
    while blocks:
        q, e, base = blocks.pop()
        while True:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= negligible * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if len(q) == 1:
                done.append(base + q[0])
                break
            if q[-1] > 1.5 * q[0]:  # the small end belongs to the bottom, where it converges
                q, e = q[::-1], e[::-1]
            step = _dqds(q, e, 0.0)
            q, e, inverse = step
            # a lower bound of the smallest eigenvalue: Newton's step from 0; the rounding is the margin's share
            shift = 0.0 if math.isinf(inverse) else (1 - 1e-10) / inverse
            while shift > EPS * EPS * base and shift > 0:
                step = _dqds(q, e, shift)
                if step is not None:
                    q, e, base = step[0], step[1], base + shift
                    break
                shift /= 4
            if q[-1] <= negligible * base or q[-1] == 0:  # the smallest eigenvalue is the base
                done.append(base)
                q, e = q[:-1], e[:-1]
    return [v * top * top for v in sorted(done, reverse=True)]


def _twist(diagonal: np.ndarray, above: np.ndarray, value: float):
    """The two factorisations of B'B - value: multipliers L+ and U-, and gamma at each place."""
    n, tiny = len(diagonal), EPS * EPS * max(value, 1e-300)
    low, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    d, l = diagonal * diagonal, above / diagonal[:-1] if n > 1 else above
    s[0] = -value
    plus = np.zeros(n)
    for i in range(n - 1):
        plus[i] = s[i] + d[i] or tiny
        low[i] = d[i] * l[i] / plus[i]
        s[i + 1] = low[i] * l[i] * s[i] - value
    plus[n - 1] = s[n - 1] + d[n - 1] or tiny
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * l[i] * l[i] + p[i + 1] or tiny
        t = d[i] / minus
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    return low, up, s + p + value, plus


def eigenvector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B from the twisted factorisation at the place of the least gamma."""
    low, up, gamma, _ = _twist(diagonal, above, value)
    r = int(np.abs(gamma).argmin())
    z = np.zeros(len(diagonal))
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, len(z) - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _solve(low: np.ndarray, plus: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L+ D+ L+' x = b."""
    x = b.copy()
    for i in range(len(low)):
        x[i + 1] -= low[i] * x[i]
    x /= plus
    for i in range(len(low) - 1, -1, -1):
        x[i] -= low[i] * x[i + 1]
    return x / np.linalg.norm(x)


def eigenvectors(diagonal: np.ndarray, above: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """Orthonormal eigenvectors of B'B for the eigenvalues, which fall."""
    floor_ = EPS * float(np.abs(diagonal).max())
    diagonal = np.where(np.abs(diagonal) < floor_, floor_, diagonal)
    rng, out, cluster = np.random.default_rng(13), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > GAP * value:
            cluster = i
        z, near = eigenvector(diagonal, above, value), out[cluster:]
        if near:
            def apart(v):
                for _ in range(2):
                    for u in near:
                        v = v - (u @ v) * u
                return v

            w = apart(z)
            if np.linalg.norm(w) < 0.5:  # the same direction once more: look in the rest of the invariant space
                low, _, _, plus = _twist(diagonal, above, value * (1 + 4 * EPS))
                w = apart(rng.standard_normal(len(z)))
                for _ in range(4):
                    w = apart(_solve(low, plus, w / np.linalg.norm(w)))
            z = w / np.linalg.norm(w)
        out.append(z)
    return out


# --- the operator ---------------------------------------------------------------------


@dataclass
class Model:
    """Whitening of integer vectors: directions (a column each) and eigenvalues of the fit list's covariance."""

    centre: Centre
    directions: np.ndarray
    values: list[float] = field(default_factory=list)
    trace: float = 0.0

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ (self.directions / np.sqrt(np.array(self.values)))


def prepared(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, the integer vector (null where it has another length or is too large), of the rows that are not dropped."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    kept = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.coalesce(finite, F.lit(False)))
    first = kept.where(F.size(v) > 0).orderBy(F.asc_nulls_last("vec_id"), F.size(v), v).select(F.size(v)).first()
    dimension = first[0] if first else 0
    fits = (F.size(v) == dimension) & (dimension > 0) & F.forall(v, lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) < 2.0 ** 50)
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + offset)
    return kept.select("vec_id", F.when(fits, x).alias("x"))


def solve(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, list[float], float]:
    """Directions, eigenvalues and trace of the covariance r'r / n."""
    diagonal, above, right = bidiagonal(r)
    values = eigenvalues(diagonal, above)
    zero = (EPS * len(diagonal)) ** 2 * values[0] if values else 0.0
    wanted = [v for v in values[:components] if v > zero]
    columns = [back(z, right) for z in eigenvectors(diagonal, above, wanted)] if wanted else []
    return np.array(columns).reshape(len(wanted), len(diagonal)).T, [v / n for v in wanted], math.fsum(values) / n


def fit(points: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, DataFrame]:
    """The model over the distinct vectors of :func:`prepared` rows (None without any), and the fit list."""
    distinct = cut_lineage(points.where(F.col("x").isNotNull()).select("x").distinct(), "whiten-fit")
    sums = distinct.mapInArrow(_sums, "place int, n long, s long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sums.orderBy("place").collect()  # one row a dimension
    if not rows:
        return None, distinct
    n, total = rows[0]["n"], np.array([r["s"] for r in rows], np.int64)
    centre = Centre(n, total // n, total % n)
    tasks = distinct.rdd.getNumPartitions()
    r = _tree(distinct.mapInArrow(_triangles(centre), "task long, height int, cells array<double>"), tasks,
              lambda parts: _triangle(np.concatenate(parts)))
    return Model(centre, *solve(r, n, components)), distinct


def identity_error(model: Model, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    if not model.values:
        return 0.0
    tasks = distinct.rdd.getNumPartitions()
    moments = _tree(distinct.mapInArrow(_moments(model), "task long, height int, cells array<double>"), tasks, _merge_moments)
    return float(np.abs(moments[2:] / moments[0, 0] - np.eye(len(model.values))).max())


def whiten(points: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation long, whitened array<double> of :func:`prepared` rows (both null where x is)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch["x"].is_valid().to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            x = _integers(batch["x"].filter(batch["x"].is_valid())).reshape(int(there.sum()), len(model.centre.whole))
            at, white, off = np.cumsum(there) - 1, model.transform(x).tolist(), model.centre.deviation(x)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array([off[i] if t else None for i, t in zip(at, there)], pa.int64()),
                 pa.array([white[i] if t else None for i, t in zip(at, there)], pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"])

    return points.mapInArrow(run, f"vec_id {dict(points.dtypes)['vec_id']}, deviation long, whitened array<double>")
