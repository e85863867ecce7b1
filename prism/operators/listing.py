"""Filtered, searched, sorted and paged lists; per-owner top-n; activity feed
(F1-F7, W1-W5, U1).

Every limit gets a total order (a key tie-break). Per-group top-n use
``row_number() <= n``, which Catalyst turns into a partial WindowGroupLimit
before the shuffle, so a hot group forwards n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.sqltext import column
from prism.operators.workspace import since

PAGE_SIZES = {"datasets": 12, "analyses": 12, "visualizations": 15, "chat_sessions": 20}


def filter_equals(df: DataFrame, **col_value) -> DataFrame:
    """equality filters (AND); a None value is skipped, as an absent query parameter."""
    cond = F.lit(True)
    for c, v in col_value.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def contains_ci(col: str, q: str) -> Column:
    """Case-insensitive literal substring test (``%``/``_`` stay literal)."""
    return F.contains(F.lower(F.col(col)), F.lower(F.lit(q)))


def search_one(df: DataFrame, col: str, q: str | None) -> DataFrame:
    """case-insensitive substring on one column; empty query keeps all."""
    return df.where(contains_ci(col, q)) if q else df


def search_any(df: DataFrame, cols: list[str], q: str | None) -> DataFrame:
    """substring on any of ``cols``."""
    if not q:
        return df
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(contains_ci(c, q), F.lit(False))
    return df.where(cond)


def filter_since(df: DataFrame, ts: str, asof: str, days: int) -> DataFrame:
    """``ts >= asof - days``."""
    return df.where(since(ts, asof, days))


def _ordered(name: str) -> Column:
    """``column`` ascending or ``-column`` descending (nulls first and last, as Spark sorts)."""
    return column(name[1:]).desc() if name.startswith("-") else column(name).asc()


def sort_order(sort: str | None, allowed: list[str], default: list, key: list[str]) -> list:
    """The order of a list: ``sort`` = column or ``-column`` from ``allowed``, else the default, then the key."""
    chosen = [sort] if sort and sort.removeprefix("-") in allowed else list(default)
    return chosen + [k for k in key if k not in [c.removeprefix("-") for c in chosen if isinstance(c, str)]]


def sort_allowlist(df: DataFrame, sort: str | None, allowed: list[str], default: list,
                   key: list[str]) -> DataFrame:
    """``sort`` = column or ``-column`` from ``allowed``; anything else keeps the default order (names
    as ``sort`` has them, or sort expressions). ``key`` columns break ties so the order is total."""
    return df.orderBy(*[_ordered(c) if isinstance(c, str) else c for c in sort_order(sort, allowed, default, key)])


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """page ``number`` (1-based) of an ordered frame."""
    return df.offset((max(number, 1) - 1) * size).limit(size)


def follows(df: DataFrame, order: list[str], after: list) -> Column:
    """Whether a row stands behind the one with the values ``after`` in ``order`` (names, ``-name`` descending)."""
    same, behind = F.lit(True), F.lit(False)
    for name, value in zip(order, after):
        down, c = name.startswith("-"), column(name.removeprefix("-"))
        v = F.lit(value).cast(df.schema[name.removeprefix("-")].dataType)
        if value is None:  # nulls come first, descending last
            step = F.lit(False) if down else c.isNotNull()
        else:
            step = (c < v) | c.isNull() if down else F.coalesce(c > v, F.lit(False))
        behind = behind | (same & step)
        same = same & c.eqNullSafe(v)
    return behind


def page_after(df: DataFrame, order: list[str], after: list | None, size: int) -> DataFrame:
    """F6 by key: the ``size`` rows that follow the row with the values ``after`` in the total
    ``order`` of names (``-name``: descending; None: the first page). A deep page costs a filter and a top-k, no offset."""
    if after is not None:
        df = df.where(follows(df, order, after))
    return df.orderBy(*map(_ordered, order)).limit(size)


def visualization_browser(df: DataFrame, *, type_col: str, type_value=None, search_cols: list[str],
                          search: str | None, parent_col: str, parent=None, sort: str | None,
                          allowed: list[str], default: list, key: list[str], number: int = 1,
                          size: int = 15, after: list | None = None) -> DataFrame:
    """F1 + F3 + F5 + F6 composed -- the flagship list query. With ``after``, the values of the last row seen in the
    columns of :func:`sort_order`, the next page is found by key whatever its depth; ``number`` pages by offset."""
    out = filter_equals(df, **{type_col: type_value, parent_col: parent})
    out = search_any(out, search_cols, search)
    if after is not None:
        return page_after(out, sort_order(sort, allowed, default, key), after, size)
    return page(sort_allowlist(out, sort, allowed, default, key), number, size)


def recent_per_owner(df: DataFrame, owner: str, ts: str, key: list[str], n: int) -> DataFrame:
    """Newest ``n`` items per owner with their rank (ties broken on ``key``)."""
    w = Window.partitionBy(owner).orderBy(F.col(ts).desc(), *[F.col(k).asc() for k in key])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn(
        "rank", F.col("rank").cast("bigint"))


def last_messages(messages: DataFrame, session: str, order: str, n: int = 10) -> DataFrame:
    """Last ``n`` messages of each conversation."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return messages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn(
        "rank", F.col("rank").cast("bigint"))


def first_user_message(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, text) of the first user message -- an aggregate, no sort of the group."""
    return (messages.where(F.col(role) == "user").groupBy(F.col(session).alias("session"))
            .agg(F.min_by(F.col(text), F.col(order)).alias("text")))


def last_user_message(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, text) of the latest user message."""
    return (messages.where(F.col(role) == "user").groupBy(F.col(session).alias("session"))
            .agg(F.max_by(F.col(text), F.col(order)).alias("text")))


def recent_sessions_by_activity(rollup: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` sessions by last activity (empty sessions last, ties on session)."""
    return rollup.orderBy(F.col("last_ts").desc_nulls_last(), F.col("session").asc()).limit(n)


def activity_feed(analyses: DataFrame, datasets: DataFrame, n_analyses: int = 5, n_datasets: int = 3,
                  n: int = 8) -> DataFrame:
    """Per owner, the newest ``n_analyses`` analyses and ``n_datasets`` datasets merged
    newest first, keeping ``n``. Inputs have columns (owner, item_id, title, description, ts)."""
    cols = ["owner", "item_id", "title", "description", "ts"]
    a = recent_per_owner(analyses.select(*cols), "owner", "ts", ["item_id"], n_analyses).drop("rank") \
        .withColumn("kind", F.lit("analysis"))
    d = recent_per_owner(datasets.select(*cols), "owner", "ts", ["item_id"], n_datasets).drop("rank") \
        .withColumn("kind", F.lit("dataset"))
    w = Window.partitionBy("owner").orderBy(F.col("ts").desc(), F.col("kind"), F.col("item_id"))
    return (a.unionByName(d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("owner", F.col("rank").cast("bigint").alias("rank"), "item_id", "title", "description", "ts", "kind"))
