"""Approximate nearest neighbours by an inverted multi-index.

Each vector half has its own codebook of ``CODES`` centroids, so ``CODES**2`` centroid pairs are
cells. A query walks the pairs in the order of summed squared distance with a heap (the
multi-sequence walk) until the visited cells hold ``max(MIN_ENTRIES, SHARE * vectors)``
entries; all entries of those cells that can be among the nearest by a distance with a bounded rounding
error, ties included, are reranked by exact Euclidean distance.

``SHARE`` is 0.6: on vectors without clusters, as in the test tables, fewer entries do not reach a
recall of 0.9 (measured in README.md). The codebooks are fitted on at most ``SAMPLE``
vectors, the first by a digest of their id; every vector is indexed.

Equal vectors are indexed once, with their smallest ids (more can't be among the
results), and a query vector is searched once however many rows share it. Cells are cut
into slices of bounded size that are packed into shards; a task compares a block of
queries with the cells of one shard that they visit. So neither a cell that holds a
third of all vectors nor a vector that is a third of all rows meets in one task.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite component take no
part, nor do null ids; all others must have one even length, else ValueError; fewer than k candidates are all returned; equal
distances rank by id; an id with several vectors is searched for each; rows that repeat an id and vector count as one; without vectors there are no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from prism.session import cut_lineage

CODES = 32
SAMPLE = 8_192
SHARE, MIN_ENTRIES = 0.6, 1_000
#: Entries of a shard, queries of a block.
SHARD, QUERY_BLOCK = 16_384, 512
#: Machine epsilon, of which the bound of the rounding error is a multiple; pairs that are measured exactly at once.
ROUNDING, PAIRS = 2.0 ** -52, 65_536


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lloyd(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = np.unique(points[:4 * k], axis=0)[:k].copy()
    for _ in range(rounds):
        nearest = _squared(points, centres).argmin(1)
        for c in np.unique(nearest):
            centres[c] = points[nearest == c].mean(0)
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Centroid pairs by summed distance, from a heap over the two sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = vectors.shape[1] // 2
    return vectors[:, :middle], vectors[:, middle:]


def _cell_udf(books: tuple[np.ndarray, np.ndarray]):
    @F.arrow_udf(IntegerType())
    def cell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.int32())
                continue
            a, b = (_squared(h, book).argmin(1) for h, book in zip(_halves(_matrix(batch)), books))
            yield pa.array(a * len(books[1]) + b, pa.int32())

    return cell


def _visit_udf(books: tuple[np.ndarray, np.ndarray], counts: dict[int, int], target: int):
    """Query vector -> the cells that it visits."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def visit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            if len(batch):
                for first, second in zip(*(_squared(h, book) for h, book in zip(_halves(_matrix(batch)), books))):
                    cells, held = [], 0
                    for i, j in walk(first, second):
                        cell = i * len(books[1]) + j
                        if cell in counts:
                            cells.append(cell)
                            held += counts[cell]
                            if held >= target:
                                break
                    out.append(cells)
            yield pa.array(out, pa.list_(pa.int32()))

    return visit


def _slices(counts: dict[int, int]) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """Slices of each cell, and (cell, slice, shard): consecutive slices fill a shard up to SHARD entries."""
    of, placed, shard, held = {}, [], 0, 0
    for cell in sorted(counts):
        of[cell] = math.ceil(counts[cell] / SHARD)
        for number in range(of[cell]):
            size = counts[cell] / of[cell]
            if held and held + size > SHARD:
                shard, held = shard + 1, 0
            placed.append((cell, number, shard))
            held += size
    return of, placed


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distance of each pair, on the original vectors, some pairs at once (ties have no bound)."""
    out = np.empty(len(row))
    for i in range(0, len(row), PAIRS):
        out[i:i + PAIRS] = np.sqrt(((q[row[i:i + PAIRS]] - x[at[i:i + PAIRS]]) ** 2).sum(1))
    return out


def _nearest(k: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        """The k nearest entries of the visited cells of one shard, for each query of one block."""
        empty = pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not entries.num_rows:
            return empty
        q, x = (_matrix(t["vector"].combine_chunks()) for t in (queries, entries))
        # distances do not change when both are moved; near the origin they lose fewer digits
        middle = x.mean(0)
        qc, xc = q - middle, x - middle
        lengths = np.sqrt((qc * qc).sum(1)), np.sqrt((xc * xc).sum(1))
        cells, ids = entries["cell"].to_numpy(), entries["entry"].to_numpy()
        visited: dict[int, list[int]] = {}
        for row, own in enumerate(queries["cells"].to_pylist()):
            for cell in own:
                visited.setdefault(cell, []).append(row)
        found = []
        for cell, rows in visited.items():
            at, rows = np.flatnonzero(cells == cell), np.array(rows)
            if not len(at):
                continue
            near = _squared(qc[rows], xc[at])
            if len(at) > k:  # all that can be among the k nearest: ties, and what rounding may have put behind them
                error = ROUNDING * (x.shape[1] + 8) * (lengths[0][rows] + lengths[1].max()) ** 2
                # the original components' own rounding, which centring cannot undo
                error = error + 4 * np.finfo(float).eps * x.shape[1] * (np.abs(middle).max() + lengths[0][rows] + lengths[1].max()) * np.sqrt(near.max(1))
                most = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error
                r, c = np.nonzero(near <= most[:, None])
            else:
                r, c = (i.ravel() for i in np.indices(near.shape))
            row, at = rows[r], at[c]
            score = _exact(q, x, row, at)
            by = np.lexsort((ids[at], score, row))
            row, at, score = row[by], at[by], score[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[keep], at[keep], score[keep]))
        if not found:
            return empty
        row, at, score = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((ids[at], score, row))
        row, at, score = row[by], at[by], score[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.table({"query": pa.array(queries["query"].to_numpy()[row[keep]], pa.int64()),
                         "entry": pa.array(ids[at[keep]], pa.int64()), "score": pa.array(score[keep])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, embedding) -> query_id, rank, vec_id, score: for each
    query its k nearest vectors found, without the row that has its own id."""
    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        return rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct()

    by_id = Window.partitionBy("vector").orderBy("vec_id")
    members = clean(vectors).withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    entries = members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = cut_lineage(entries.select(F.get("ids", F.lit(0)).alias("entry"), "ids", "vector"), "ann-entries")
    asked = clean(queries).alias("a")
    size = F.size("vector")
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if not facts["n"]:
        return entries.select(F.col("entry").alias("query_id"), F.lit(1).alias("rank"), F.col("entry").alias("vec_id"),
                              F.lit(0.0).alias("score"))
    if facts["least"] != facts["most"] or facts["least"] % 2:
        raise ValueError("the vectors must have one even length")
    chosen = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("vector").toArrow()["vector"]
    books = tuple(_lloyd(h, CODES) for h in _halves(_matrix(chosen.combine_chunks())))
    indexed = cut_lineage(entries.select("entry", "vector", _cell_udf(books)("vector").alias("cell")), "ann-index")
    counts = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # at most CODES ** 2
    slices, placed = _slices(counts)
    spark = vectors.sparkSession
    shards = [(c, s, slices[c], h) for c, s, h in placed]
    where = spark.createDataFrame(shards, "cell int, slice int, slices int, shard int")
    own = F.pmod(F.xxhash64("entry"), F.col("slices"))
    dealt = indexed.join(where, "cell").where(F.col("slice") == own).select("entry", "vector", "cell", "shard")
    # the distinct query vectors, with the id of the first row that has it
    distinct = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))
    total = distinct.count()
    blocks = math.ceil(total / QUERY_BLOCK) or 1
    target = max(MIN_ENTRIES, math.ceil(SHARE * facts["n"]))
    visits = distinct.withColumn("visited", _visit_udf(books, counts, target)("vector"))
    visits = cut_lineage(visits.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "ann-visits")
    sent = (visits.select("query", "vector", "block", F.explode("visited").alias("cell"))
            .join(spark.createDataFrame([(c, h) for c, _, _, h in shards], "cell int, shard int"), "cell")
            .groupBy("query", "shard").agg(F.collect_set("cell").alias("cells")))
    sent = sent.join(visits.select("query", "vector", "block"), "query").select("query", "vector", "cells", "shard", "block")
    spread = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(
        _nearest(k + 1), "query long, entry long, score double")
    near = Window.partitionBy("query").orderBy("score", "entry")
    best = found.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1)
    hits = best.join(entries.select("entry", "ids"), "entry").select(
        "query", F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id"))).alias("hits"))
    lists = hits.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    d = distinct.alias("d")
    per_query = (asked.join(d, F.col("a.vector") == F.col("d.vector"))
                 .select(F.col("a.vec_id").alias("query_id"), "d.query").join(lists, "query"))
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return (per_query.select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"))
