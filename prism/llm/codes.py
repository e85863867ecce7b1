"""Vector code compression: product codes from integer codebooks, with LAESA pivots.

A vector's components become integers, ``floor(SCALE * x)``; it is cut into ``parts`` consecutive parts, and
each part position has a codebook that starts as that part of the first vectors by id and is
refined by ``rounds`` of assignment and componentwise floored means. A vector's code is the nearest entry's index
for each part; everything is exact integer arithmetic.

The search for the nearest entry is LAESA's. Each part position has a few fixed pivots, taken
farthest first from its starting codebook; the squared distances of all parts to them are computed
once and written with the vectors. In each round only the distances of pivots and entries are new. By the
triangle inequality |d(part, pivot) - d(pivot, entry)| bounds the distance of part and entry from
below, so a part's entries are evaluated in the order of their greatest bound until the next bound
lies beyond the best distance found. The bounds only order and prune: a pruned entry cannot be
nearer, nor as near with a lower index.

A round is one scan: each task sums its parts by (part, entry), so one row for each of these and a task is
shuffled, however the vectors repeat. The codebooks (parts x entries vectors) are the only thing
that meets on the driver. Label sums are one row a label and joined back, by broadcast only where
their written size allows.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; the
dimension is that of the smallest id's non-empty vector, and rows of another length, or
with an integer component that could overflow a long sum of squares, come back with null code and error and take
no part in the codebooks; where the dimension is no multiple of the parts, part p starts at floor(p * dimension
/ parts); ids may be null (they come last) or repeat (then the vectors decide); with fewer
vectors than entries the codebooks are smaller; equal distances go to the lower index; an entry
without parts stays; labels that are null count as one label; without rows there are no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 256, 16, 64, 2, 4
#: Points of a part that are searched at once.
BLOCK = 16_384


def finite(vector: Column) -> Column:
    """Whether the vector is there and has only finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(whole, F.lit(False))


def bounds(dimension: int, parts: int) -> list[int]:
    return [p * dimension // parts for p in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a and b (long)."""
    return sum((a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1])) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


def pivots_of(book: np.ndarray, n: int) -> np.ndarray:
    """Up to n entries of a codebook, farthest first from the first one, without repeats."""
    chosen, near = [0], squared(book, book[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest(points: np.ndarray, near: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each point's nearest entry, ties to the lower index, and how many distances
    were evaluated. ``near`` holds the points' squared distances to the pivots."""
    n = len(points)
    to_pivot, to_entry = np.sqrt(near.astype(float)), np.sqrt(squared(pivots, book).astype(float))
    bound = np.abs(to_pivot[:, :1] - to_entry[0])
    for p in range(1, len(pivots)):
        np.maximum(bound, np.abs(to_pivot[:, p, None] - to_entry[p]), out=bound)
    # rounding may have lifted a bound by a few units in the last place of its terms
    bound -= 1e-14 * (to_pivot.max(1)[:, None] + to_entry.max())
    order = np.argsort(bound, axis=1, kind="stable")
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    open_, evaluated = np.arange(n), 0
    for step in range(len(book)):
        entry = order[open_, step]
        if step:  # the others are settled: all further bounds are greater still
            still = bound[open_, entry] <= np.sqrt(best[open_].astype(float)) * (1 + 1e-14)
            open_, entry = open_[still], entry[still]
        if not len(open_):
            break
        evaluated += len(open_)
        d = ((points[open_] - book[entry]) ** 2).sum(1)
        better = (d < best[open_]) | ((d == best[open_]) & (entry < index[open_]))
        at = open_[better]
        best[at], index[at] = d[better], entry[better]
    return index, best, evaluated


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _lists(a: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(a.reshape(-1), kind))


class Search:
    """The nearest entries of batches of (x, near) for given codebooks."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
        self.near_cuts = np.cumsum([0, *(len(p) for p in pivots)]).tolist()

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of all parts to their pivots, part after part."""
        return np.concatenate([squared(x[:, a:b], p) for a, b, p in zip(self.cuts, self.cuts[1:], self.pivots)], axis=1)

    def assign(self, x: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part: the indexes of the nearest entries and the squared distances."""
        for p, (book, pivots) in enumerate(zip(self.books, self.pivots)):
            points, own = x[:, self.cuts[p]:self.cuts[p + 1]], near[:, self.near_cuts[p]:self.near_cuts[p + 1]]
            found = [nearest(points[i:i + BLOCK], own[i:i + BLOCK], book, pivots) for i in range(0, len(x), BLOCK)]
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _measure(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _lists(search.distances(_matrix(batch["x"])))
                yield pa.RecordBatch.from_arrays([*batch.columns, near], [*batch.schema.names, "near"])

    return run


def _sums(search: Search):
    """Per task one row for each part, entry and position: parts assigned, and the sum of their components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in search.books]
        sums = [np.zeros(b.shape, np.int64) for b in search.books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            for p, (index, _) in enumerate(search.assign(x, _matrix(batch["near"]))):
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(sums[p], index, x[:, search.cuts[p]:search.cuts[p + 1]])
        for p, (n, s) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(n)
            entry, place = np.repeat(used, s.shape[1]), np.tile(np.arange(s.shape[1]), len(used))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(entry), p), pa.int32()), "entry": pa.array(entry, pa.int32()),
                "place": pa.array(place, pa.int32()), "n": pa.array(n[entry], pa.int64()), "s": pa.array(s[entry, place], pa.int64())})

    return run


def _codes(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(search.assign(_matrix(batch["x"]), _matrix(batch["near"])))
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["label"], _lists(np.stack([f[0] for f in found], 1), pa.int32()),
                     pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def refined(points: DataFrame, search: Search) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts assigned to each entry."""
    rows = (points.mapInArrow(_sums(search), "part int, entry int, place int, n long, s long")
            .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow())
    books = [b.copy() for b in search.books]
    part, entry, place, n, s = (rows[c].to_numpy() for c in ("part", "entry", "place", "n", "s"))
    for p, book in enumerate(books):
        own = part == p
        book[entry[own], place[own]] = s[own] // n[own]  # numpy's integer division floors
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of the vectors (columns vec_id, embedding, label) as vec_id, label, code array<int>, error long, label_error long; and
    the final codebooks, one integer matrix a part."""
    kept = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").alias("v")).where(finite(F.col("v")))
    first = kept.where(F.size("v") > 0).orderBy(F.asc_nulls_last("vec_id"), F.size("v"), "v").select(F.size("v")).first()
    dimension = first[0] if first else 0
    # the sum of squared differences of two vectors, as of two sums, must fit in a long
    most = int((2 ** 61 / max(dimension, 1)) ** 0.5)
    scaled = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = (F.size("v") == dimension) & (dimension > 0) & F.forall("v", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < most)
    kind = "int" if most < 2 ** 31 else "long"
    points = kept.where(fits).select("vec_id", "label", scaled.cast(f"array<{kind}>").alias("x"))
    start = points.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    others = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if start:
        x, cuts = np.array([r["x"] for r in start], np.int64), bounds(dimension, parts)
        books = [x[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
        pivots = [pivots_of(b, PIVOTS) for b in books]
        types = dict(points.dtypes)
        schema = f"vec_id {types['vec_id']}, label {types['label']}"
        measured = points.mapInArrow(_measure(Search(books, pivots)), f"{schema}, x array<{kind}>, near array<long>")
        measured = cut_lineage(measured, "codes-points")
        for _ in range(rounds):
            books = refined(measured, Search(books, pivots))
        coded = measured.mapInArrow(_codes(Search(books, pivots)), f"{schema}, code array<int>, error long")
        others = coded.unionByName(others)
    else:
        books = []
    coded = cut_lineage(others, "codes-assigned")
    sums = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def hex_code(code: Column) -> Column:
    """A code as two lower-case hex digits an index."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """The coded rows with the column ``decoded``: the vector that the code stands for (array<double>)."""
    @F.arrow_udf("array<double>")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (c := code.as_py()) is None else [int(v) / scale for p, i in enumerate(c) for v in books[p][i]]
                            for code in batch], pa.list_(pa.float64()))

    return coded.withColumn("decoded", decoded(F.col("code")))
