"""The most frequent values of text columns without shuffling every distinct value.

1. One aggregate keeps a frequent-items sketch (weighted Misra-Gries) of every column, merged in two steps. Long values
   are represented by a digest, so texts do not travel.
2. Where the sketch dropped nothing, its counts are exact and nothing more is read. Otherwise the
   ``CANDIDATES`` largest entries are counted exactly in one scan (they are few, so they are broadcast).
3. A value that is no candidate occurs at most as often as the sketch's error bound and its last candidate allow. If
   the ``n``-th exact count is greater, the candidates are complete, ties included. Where it is not (as for a column
   of keys, which has no frequent values), all values of that column are counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.sqltext import column
from prism.operators.quantiles import by_tasks

#: Entries that a sketch tracks (a power of two), candidates that are counted exactly, and the longest value that is its own key.
TRACKED, CANDIDATES, SHORT = 4_096, 256, 64
#: Fixed value: a sketch whose map has m places is wrong by at most ERROR / m of the rows.
ERROR = 3.5


@dataclass
class _Column:
    name: str
    pos: int
    rows: int
    entries: dict[str, int]                 # key -> estimate
    counts: dict[str, int] = field(default_factory=dict)

    def exact(self) -> bool:
        """The estimates are upper bounds, so they are exact where they add up to the rows."""
        return sum(self.entries.values()) == self.rows

    def winners(self, n: int) -> list[str] | None:
        """The keys that may be among the n most frequent, or None where the counts do not prove it."""
        ranked = sorted(self.counts.values(), reverse=True)
        least = ranked[n - 1] if len(ranked) >= n else 0
        if sum(ranked) < self.rows:  # there are values that are no candidates
            last = min(self.entries.values()) if len(self.entries) >= CANDIDATES else 0
            if least <= max(last, 2 * ERROR * self.rows / TRACKED):
                return None
        keys = [k for k, c in self.counts.items() if c >= least]
        return keys if len(keys) <= CANDIDATES else None


def _key(name: str) -> Column:
    """A value where it is short, else its length and a digest of 128 letters: longer than any short value."""
    v = column(name).cast("string")
    return F.when(F.octet_length(v) <= SHORT, v).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), F.sha2(v, 512)))


def _is_digest(key: str) -> bool:
    return len(key) > SHORT


def _sketches(keys: DataFrame) -> list[tuple[int, dict[str, int]]]:
    """Of each column: rows with a value, and the largest entries of its sketch."""
    places = TRACKED * 3 // 4
    # a row of missing values counts for nothing, but an empty table has a sketch by it
    none = keys.sparkSession.range(1).selectExpr(*[f"CAST(NULL AS STRING) AS {k}" for k in keys.columns])
    parts = by_tasks(keys.unionByName(none)).groupBy("g").agg(*[F.expr(e) for k in keys.columns for e in (
        f"count({k}) AS {k}_n", f"approx_top_k_accumulate({k}, {places}) FILTER (WHERE {k} IS NOT NULL) AS {k}_s")])
    merged = parts.agg(*[F.expr(e) for k in keys.columns for e in (
        f"coalesce(sum({k}_n), 0) AS {k}_n", f"approx_top_k_combine({k}_s, {places}) AS {k}_s")])
    row = merged.selectExpr(*[e for k in keys.columns for e in (f"{k}_n", f"approx_top_k_estimate({k}_s, {CANDIDATES}) AS {k}")]).first()
    return [(row[f"{k}_n"], {r["item"]: r["count"] for r in row[k] or [] if r["item"] is not None}) for k in keys.columns]


def _recount(keys: DataFrame, columns: list[_Column]) -> None:
    """Exact counts of the candidates of the columns, in one scan."""
    wanted = keys.sparkSession.createDataFrame([(c.pos, k) for c in columns for k in c.entries], "pos int, key string")
    rows = keys.selectExpr("inline(array(" + ", ".join(f"struct({c.pos} AS pos, k{c.pos} AS key)" for c in columns) + "))")
    counts = rows.where("key IS NOT NULL").join(F.broadcast(wanted), ["pos", "key"]).groupBy("pos", "key").count().collect()
    by_pos = {c.pos: c for c in columns}
    for r in counts:
        by_pos[r["pos"]].counts[r["key"]] = r["count"]


def _texts(df: DataFrame, columns: list[_Column], digests: list[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """The values that some digests stand for, in one scan of their columns."""
    if not digests:
        return {}
    own = [c for c in columns if c.pos in {pos for pos, _ in digests}]
    both = df.select(*[e for c in own for e in (_key(c.name).alias(f"k{c.pos}"), column(c.name).cast("string").alias(f"v{c.pos}"))])
    rows = both.selectExpr("inline(array(" + ", ".join(f"struct({c.pos} AS pos, k{c.pos} AS key, v{c.pos} AS value)" for c in own) + "))")
    few = df.sparkSession.createDataFrame(digests, "pos int, key string")
    found = rows.join(F.broadcast(few), ["pos", "key"]).groupBy("pos", "key").agg(F.min("value").alias("value"))
    return {(r["pos"], r["key"]): r["value"] for r in found.collect()}


def count_all(df: DataFrame, name: str, n: int) -> DataFrame:
    """(column_name, rank, value, count) of one column by counting all its values."""
    own = column(name).cast("string")
    counts = df.where(own.isNotNull()).select(own.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("value").asc()]
    top = counts.orderBy(*order).limit(n)
    return top.select(F.lit(name).alias("column_name"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "value", "count")


def top_values(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """(column_name, rank, value, count): the ``n`` most frequent values of each column, ties by value."""
    keys = df.select(*[_key(c).alias(f"k{i}") for i, c in enumerate(cols)])
    columns = [_Column(c, i, rows, entries) for i, (c, (rows, entries)) in enumerate(zip(cols, _sketches(keys)))]
    for c in columns:
        if c.exact():
            c.counts = c.entries
    if open_ := [c for c in columns if not c.exact()]:
        _recount(keys, open_)
    winners = {c.pos: c.winners(n) for c in columns}
    texts = _texts(df, columns, [(pos, k) for pos, won in winners.items() for k in won or [] if _is_digest(k)])
    rows, rest = [], []
    for c in columns:
        if winners[c.pos] is None:
            rest.append(count_all(df, c.name, n))
            continue
        ranked = sorted(((-c.counts[k], texts[c.pos, k] if _is_digest(k) else k) for k in winners[c.pos]),
                        key=lambda r: (r[0], r[1].encode("utf-8", "surrogatepass")))[:n]
        rows += [(c.name, rank, value, -count) for rank, (count, value) in enumerate(ranked, 1)]
    known = df.sparkSession.createDataFrame(rows, "column_name string, rank long, value string, count long")
    return reduce(DataFrame.unionByName, rest, known)
