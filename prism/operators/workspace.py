"""Workspace roll-ups (A12-A23): counts per owner, per day, per session.

Child tables are aggregated to their join key *before* joining parents, so a
join never multiplies rows that a group-by then has to shuffle again, and a hot
owner costs one partial-aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(ts: str, asof: str, days: int) -> Column:
    """``ts >= asof - days`` with an explicit ``asof`` instead of now()."""
    return F.col(ts) >= (F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def global_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row, ``sum_<col>`` with NULL -> 0."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in cols])


def count_by_type(df: DataFrame, col: str) -> DataFrame:
    """(value, count) rows per category."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def status_counts(df: DataFrame, status: str, mapping: dict[str, str], by: str | None = None) -> DataFrame:
    """``mapping`` output name -> status value, counted side by side (optionally per ``by``)."""
    aggs = [F.count_if(F.col(status) == F.lit(v)).alias(name) for name, v in mapping.items()]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def per_owner_counts(df: DataFrame, owner: str, name: str) -> DataFrame:
    return df.groupBy(F.col(owner).alias("owner")).agg(F.count(F.lit(1)).alias(name))


def counts_via_parent(children: DataFrame, child_fk: str, parents: DataFrame, parent_key: str,
                      parent_owner: str, name: str) -> DataFrame:
    """(owner, name): children counted per owner through their parent. Children
    are counted per parent first, so the join moves one row per parent."""
    per_parent = children.groupBy(F.col(child_fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return (parents.select(F.col(parent_key).alias("_k"), F.col(parent_owner).alias("owner"))
            .join(per_parent, "_k").groupBy("owner").agg(F.sum("_n").alias(name)))


def workspace_counts(owners: DataFrame, owner_key: str, children: dict) -> DataFrame:
    """Owners left-joined with each child table's per-owner count (0 when none).

    ``children`` maps an output name to (frame, owner column of that frame), or
    to an already aggregated (owner, name) frame such as :func:`counts_via_parent`.
    """
    out = owners.select(F.col(owner_key).alias("owner"))
    for name, spec in children.items():
        agg = spec if isinstance(spec, DataFrame) else per_owner_counts(spec[0], spec[1], name)
        out = out.join(agg, "owner", "left")
    return out.select("owner", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in children])


def recent_activity_counts(df: DataFrame, owner: str, ts: str, asof: str, days: int = 7) -> DataFrame:
    """(owner, n_recent) -- items with ``ts >= asof - days``."""
    return df.groupBy(F.col(owner).alias("owner")).agg(F.count_if(since(ts, asof, days)).alias("n_recent"))


def recent_activity(owners: DataFrame, owner_key: str, children: dict[str, tuple[DataFrame, str, str, str]],
                    days: int = 7) -> DataFrame:
    """A16 over several entities: (owner, one count a child) for every owner, 0 where idle.
    ``children``: name -> (frame, owner column, time column, asof). Only recent rows are counted, per owner, before the joins."""
    return workspace_counts(owners, owner_key, {
        name: per_owner_counts(df.where(since(ts, asof, days)), owner, name) for name, (df, owner, ts, asof) in children.items()})


def active_days(df: DataFrame, owner: str, ts: str, asof: str, days: int = 30) -> DataFrame:
    """(owner, days_active) -- distinct calendar days with activity in the window."""
    return (df.where(since(ts, asof, days))
            .groupBy(F.col(owner).alias("owner"))
            .agg(F.count_distinct(F.to_date(ts)).alias("days_active")))


def daily_counts(df: DataFrame, ts: str, asof: str, days: int = 30) -> DataFrame:
    """(day, count) over the last ``days`` days, ordered by day."""
    return (df.where(since(ts, asof, days))
            .groupBy(F.to_date(ts).alias("day"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("day"))


def monthly_activity(df: DataFrame, ts: str) -> DataFrame:
    """(month, count) with month = first day of the month."""
    return (df.groupBy(F.to_date(F.date_trunc("month", F.col(ts))).alias("month"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("month"))


def session_rollup(sessions: DataFrame, session_key: str, messages: DataFrame, message_key: str,
                   message_ts: str) -> DataFrame:
    """(session, last_ts, n) -- every session, 0 messages for empty ones.

    Messages are aggregated per session first, then left-joined: the join moves
    one row per session instead of one per message.
    """
    agg = messages.groupBy(F.col(message_key).alias("session")).agg(
        F.max(message_ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return (sessions.select(F.col(session_key).alias("session"))
            .join(agg, "session", "left")
            .select("session", "last_ts", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def avg_per_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Total messages / max(number of sessions, 1); sessions without messages count."""
    counts = messages.agg(F.count(F.lit(1)).alias("m"), F.lit(0).cast("bigint").alias("s")).unionByName(
        sessions.agg(F.lit(0).cast("bigint").alias("m"), F.count(F.lit(1)).alias("s")))
    return counts.agg((F.sum("m") / F.greatest(F.sum("s"), F.lit(1))).alias("avg_messages_per_session"))


def chat_stats(messages: DataFrame, session_key: str, role: str, message_class: Column, sessions: DataFrame,
               key: str) -> DataFrame:
    """One row -- all rows of ``sessions``, those with a user message, total messages and
    analysis messages (class data_analysis/data_exploration). Messages are combined per
    session before they meet the sessions."""
    per = messages.groupBy(F.col(session_key).alias("_s")).agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col(role) == "user").alias("u"),
        F.count_if((F.col(role) == "user") & message_class.isin("data_analysis", "data_exploration")).alias("a"))
    own = sessions.select(F.col(key).alias("_s"), F.lit(1).alias("own"))
    return own.join(per, "_s", "full").agg(
        F.count("own").alias("total_sessions"), F.count_if((F.col("own") == 1) & (F.col("u") > 0)).alias("active_sessions"),
        F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("total_messages"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("analysis_messages"))


def session_counters(messages: DataFrame, session_key: str, role: str, message_class: Column) -> DataFrame:
    """(session, message_count, analysis_count) recounted from the messages
    (replaces read-modify-write ``+= 1``). A user message of class
    data_analysis or data_exploration counts as an analysis."""
    return messages.groupBy(F.col(session_key).alias("session")).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if((F.col(role) == "user") & message_class.isin("data_analysis", "data_exploration")).alias("analysis_count"),
    )
