"""Exact quantiles (linear interpolation, as pandas/NumPy default) without
gathering a column into one task.

Spark's exact ``percentile`` keeps a value->count map per group, so for a
continuous column its final merge holds every distinct value in one task.
Instead the order statistics are located by narrowing a value bracket:

1. the statistics pass (count, mean, std, min, max of every column) carries a KLL sketch of
   every column over all its rows, which proposes a bracket [lo, hi] around each quantile;
2. a counting pass counts per bracket the values below ``lo``, equal to ``lo``, strictly
   inside and equal to ``hi``. Ties on the edges (a hot value holding a third of the
   rows) are resolved by the counts alone. Where more than ``leaf`` values may lie inside, the
   pass carries a KLL sketch of the inside, which proposes the next, some hundred times
   narrower bracket for another counting pass. A bracket that misses its rank is taken wider, up to
   the last one that held;
3. the returned plan collects the <= ``leaf`` inside values of each bracket, grouped by target, so
   the targets are spread over the tasks.

So a column of up to some millions of values takes three passes, and each factor of a hundred one more. Sketches and
statistics are merged in two steps, first those of ``FAN`` tasks, so no task merges one for every
task of the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prism.functions.sqltext import clean_double, dlit

#: Size parameter of the sketches, and how many tasks' partial results are merged first.
KLL, FAN = 4_096, 64
#: The normalised rank error of a KLL sketch (99 % of estimates) is A / k ** B.
ERROR_A, ERROR_B = 2.296, 0.9021


def kll_error(k: int) -> float:
    return ERROR_A / k ** ERROR_B


def kll_size(accuracy: int) -> int:
    """The size parameter for a rank error of 1 / accuracy (at most what a sketch allows)."""
    return max(8, min(65_535, math.ceil((ERROR_A * accuracy) ** (1 / ERROR_B))))


def clean_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as clean doubles (NaN is NULL) named c0, c1, ..."""
    return df.selectExpr(*[f"{clean_double(c)} AS c{i}" for i, c in enumerate(cols)])


def by_tasks(df: DataFrame) -> DataFrame:
    """The rows with g, the group of FAN tasks whose partial results are merged first."""
    return df.withColumn("g", F.floor(F.spark_partition_id() / FAN))


def statistics(work: DataFrame, k: int) -> DataFrame:
    """One row: n, mean, std, min, max and a KLL sketch s of every column of :func:`clean_columns`."""
    cols = work.columns
    partial = [e for c in cols for e in (
        f"count({c}) AS {c}_n", f"avg({c}) AS {c}_mean", f"var_pop({c}) * count({c}) AS {c}_m2", f"min({c}) AS {c}_min",
        f"max({c}) AS {c}_max", f"kll_sketch_agg_double({c}, {k}) AS {c}_s")]
    parts = by_tasks(work).groupBy("g").agg(*map(F.expr, partial))
    merged = [e for c in cols for e in (
        f"coalesce(sum({c}_n), 0) AS {c}_n", f"min({c}_min) AS {c}_min", f"max({c}_max) AS {c}_max", f"kll_merge_agg_double({c}_s) AS {c}_s",
        # some rows for every FAN tasks; in a fixed order, so that reruns agree
        f"aggregate(array_sort(collect_list(named_struct('g', g, 'n', CAST({c}_n AS DOUBLE), 'mean', {c}_mean, 'm2', {c}_m2)) FILTER (WHERE {c}_n > 0)), "
        "named_struct('n', 0D, 'mean', 0D, 'm2', 0D), (a, b) -> named_struct('n', a.n + b.n, "
        "'mean', a.mean + (b.mean - a.mean) * (b.n / (a.n + b.n)), "
        f"'m2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * (a.n * (b.n / (a.n + b.n))))) AS {c}_moments")]
    one = parts.agg(*map(F.expr, merged))
    return one.selectExpr(*[e for c in cols for e in (
        f"{c}_n", f"IF({c}_n > 0, {c}_moments.mean, NULL) AS {c}_mean",
        f"IF({c}_n > 1, sqrt({c}_moments.m2 / ({c}_n - 1)), NULL) AS {c}_std", f"{c}_min", f"{c}_max", f"{c}_s")])


def sketched(column: str, p: float) -> str:
    """SQL of a quantile of the sketch of :func:`statistics`."""
    return f"IF({column}_n > 0, kll_sketch_get_quantile_double({column}_s, {dlit(min(1.0, max(0.0, p)))}), NULL)"


@dataclass
class _Target:
    """One quantile of one column: the ranks it needs, a bracket, and the counts around it."""

    tid: int
    col: str
    n: int
    p: float
    lo: float
    hi: float
    expected: float         # how many values may lie inside the bracket
    below: int = 0
    eq_lo: int = 0
    mid: int = 0
    eq_hi: int = 0
    done: tuple[float, float] | None = None   # resolved order statistics x(r_lo), x(r_hi)
    sketch: bytes | None = None               # of the inside of the last bracket that held both ranks,
    span: tuple[float, float] = (0.0, 1.0)    # in which the ranks lie at these shares,
    spread: float = 0.0                       # taken wider by this share

    def __post_init__(self) -> None:
        h = (self.n - 1) * self.p
        self.r_lo = int(math.floor(h))
        self.r_hi = min(self.r_lo + 1, self.n - 1)
        self.frac = h - self.r_lo

    @property
    def inside(self) -> str:
        return f"({self.col} > {dlit(self.lo)} AND {self.col} < {dlit(self.hi)})"

    def edge(self, r: int) -> float | None:
        """x(r) when it is one of the bracket's edge values, else None."""
        k = r - self.below
        return self.lo if k < self.eq_lo else self.hi if k >= self.eq_lo + self.mid else None

    def counted(self, row: dict) -> bool:
        """Take the counts around the bracket; whether it holds both ranks."""
        self.below, self.eq_lo, self.mid, self.eq_hi = (row[f"{k}{self.tid}"] for k in ("below", "lo", "mid", "hi"))
        if not self.below <= self.r_lo <= self.r_hi < self.below + self.eq_lo + self.mid + self.eq_hi:
            return False
        a, b = self.edge(self.r_lo), self.edge(self.r_hi)
        if a is not None and b is not None:
            self.done = a, b
        return True


class QuantilePlan:
    """The located order statistics of ``cols`` x ``probs`` and the columns' statistics."""

    def __init__(self, work: DataFrame, probs: list[float], stats: Row, targets: dict[tuple[int, int], _Target]):
        self.work, self.probs, self.stats, self.targets = work, probs, stats, targets

    def rows(self) -> DataFrame:
        """(pos, k, value): the quantile k of the column pos, null for a column without values. Rows outside the open brackets are
        filtered out before the rest is collected, grouped by target."""
        known, open_ = [], []
        for pos in range(len(self.work.columns)):
            for k in range(len(self.probs)):
                t = self.targets.get((pos, k))
                if t is not None and t.done is None:
                    open_.append((pos, k, t))
                else:
                    value = "CAST(NULL AS DOUBLE)" if t is None else self._between(t, *map(dlit, t.done))
                    known.append(f"named_struct('pos', {pos}, 'k', {k}, 'value', {value})")
        one = self.work.sparkSession.range(1)
        out = one.selectExpr(f"inline(array({', '.join(known)}))") if known else None
        if not open_:
            return out
        entries = ", ".join(f"IF({t.inside}, named_struct('pos', {pos}, 'k', {k}, 'v', {t.col}), NULL)" for pos, k, t in open_)
        values = (self.work.where(" OR ".join(t.inside for _, _, t in open_))
                  .selectExpr(f"inline(filter(array({entries}), x -> x IS NOT NULL))"))
        lists = values.groupBy("pos", "k").agg(F.sort_array(F.collect_list("v")).alias("v"))
        cases = " ".join(f"WHEN pos = {pos} AND k = {k} THEN {self._between(t, *(self._at(t, r) for r in (t.r_lo, t.r_hi)))}" for pos, k, t in open_)
        found = lists.selectExpr("pos", "k", f"CASE {cases} END AS value")
        return found if out is None else out.unionByName(found)

    @staticmethod
    def _at(t: _Target, r: int) -> str:
        edge = t.edge(r)
        return dlit(edge) if edge is not None else f"v[{r - t.below - t.eq_lo}]"

    @staticmethod
    def _between(t: _Target, a: str, b: str) -> str:
        return f"({a} + ({b} - {a}) * {dlit(t.frac)})"


def _count(work: DataFrame, targets: list[_Target], wide: list[_Target], k: int) -> dict[str, int | bytes]:
    """Counts around every bracket, and a sketch of the inside of the wide ones."""
    # up to each edge, of brackets that targets share only once; the counts are their differences
    edges = {(t.col, op, dlit(edge)): None for t in targets for edge in (t.lo, t.hi) for op in ("<", "<=")}
    names = {key: f"n{i}" for i, key in enumerate(edges)}
    counts = [f"count_if({col} {op} {edge}) AS {names[col, op, edge]}" for col, op, edge in edges]

    def taken(row: Row) -> dict[str, int | bytes]:
        out = {}
        for t in targets:
            below, to_lo, under, to_hi = (row[names[t.col, op, dlit(edge)]] for edge in (t.lo, t.hi) for op in ("<", "<="))
            one = t.lo == t.hi
            out |= {f"below{t.tid}": below, f"lo{t.tid}": to_lo - below, f"mid{t.tid}": 0 if one else under - to_lo,
                    f"hi{t.tid}": 0 if one else to_hi - under}
        return out | {f"sketch{t.tid}": row[f"sketch{t.tid}"] for t in wide}

    if not wide:
        return taken(work.agg(*map(F.expr, counts)).first())
    sketches = [f"kll_sketch_agg_double(CASE WHEN {t.inside} THEN {t.col} END, {k}) AS sketch{t.tid}" for t in wide]
    parts = by_tasks(work).groupBy("g").agg(*map(F.expr, counts + sketches))
    return taken(parts.agg(*[F.expr(f"sum({n}) AS {n}") for n in names.values()],
                           *[F.expr(f"kll_merge_agg_double(sketch{t.tid}) AS sketch{t.tid}") for t in wide]).first())


def _propose(spark: SparkSession, targets: list[_Target]) -> None:
    """The next bracket of each target, from the sketch of the inside of its last one."""
    one = spark.createDataFrame([tuple(bytearray(t.sketch) for t in targets)], ", ".join(f"s{t.tid} binary" for t in targets))
    shares = [(t, n, p) for t in targets for n, p in
              (("least", 0.0), ("lo", max(0.0, t.span[0] - t.spread)), ("hi", min(1.0, t.span[1] + t.spread)), ("most", 1.0))]
    found = one.selectExpr(*[f"kll_sketch_get_quantile_double(s{t.tid}, {dlit(p)}) AS {n}{t.tid}" for t, n, p in shares]).first()
    for t in targets:
        r, a, b = {n: found[f"{n}{t.tid}"] for n in ("least", "lo", "hi", "most")}, t.edge(t.r_lo), t.edge(t.r_hi)
        if a is not None or b is not None:  # one rank is an edge, the other the first or last value inside
            t.done = (a, r["least"]) if a is not None else (r["most"], b)
        t.lo, t.hi, t.expected = r["lo"], r["hi"], t.mid * 2 * t.spread


def plan_exact_quantiles(work: DataFrame, probs: list[float], leaf: int = 50_000, k: int = KLL) -> QuantilePlan:
    """Locate the quantiles of the columns of :func:`clean_columns`."""
    cols, spark, reach = work.columns, work.sparkSession, 2 * kll_error(k)
    at = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    stats = statistics(work, k).selectExpr(*[f"{c}_{s}" for c in cols for s in ("n", "mean", "std", "min", "max")], *[
        f"{sketched(cols[i], probs[j] + sign * reach)} AS {side}{i}_{j}" for i, j in at for side, sign in (("lo", -1), ("hi", 1))]).first()
    targets = {}
    for tid, (i, j) in enumerate(at):
        if n := stats[f"{cols[i]}_n"]:
            lo, hi, ends = stats[f"lo{i}_{j}"], stats[f"hi{i}_{j}"], (stats[f"{cols[i]}_min"], stats[f"{cols[i]}_max"])
            targets[i, j] = _Target(tid, cols[i], n, probs[j], lo, hi, 2 * reach * n, done=ends if ends[0] == ends[1] else None)
    todo = [t for t in targets.values() if t.done is None]
    while todo:
        wide, again, narrower = [t for t in todo if t.expected > leaf], [], []
        row = _count(work, todo, wide, k)
        for t in todo:
            before = t.below, t.eq_lo, t.mid, t.eq_hi
            if t.counted(row):
                if t.done is not None or t.mid <= leaf:
                    continue
                if t not in wide:  # more values than the sketch made expect: count them once more, with a sketch
                    t.expected = t.mid
                    again.append(t)
                    continue
                first = t.r_lo - t.below - t.eq_lo
                t.sketch, t.span, t.spread = row[f"sketch{t.tid}"], (first / t.mid, (first + 2) / t.mid), reach
                narrower.append(t)
            elif t.sketch is None:  # the sketch of all values missed the ranks
                t.lo, t.hi, t.expected = stats[f"{t.col}_min"], stats[f"{t.col}_max"], t.n
                again.append(t)
            else:
                t.below, t.eq_lo, t.mid, t.eq_hi = before
                t.spread *= 8
                narrower.append(t)
        if narrower:
            _propose(spark, narrower)
        todo = again + [t for t in narrower if t.done is None]
    return QuantilePlan(work, probs, stats, targets)


def quantile_columns(plan: QuantilePlan) -> DataFrame:
    """(pos, p0, p1, ...): one row a column."""
    return plan.rows().groupBy("pos").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"p{k}") for k in range(len(plan.probs))])
