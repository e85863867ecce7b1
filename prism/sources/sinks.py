"""Result writers.

Documents are produced as DataFrame columns (``to_json``) and written by Spark's
own writers. Transcripts are emitted as ordered *lines* (header, then one
record per message) instead of one array per session: a session with a third
of all messages is then range-partitioned over many tasks by (session, line)
rather than collected into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampNTZType, TimestampType

from prism.functions.scalar import fn_iso_timestamp
from prism.functions.sqltext import column

# Display names of message roles and the transcript layout.
ROLE_DISPLAY = {"user": "Utilisateur", "assistant": "Assistant", "system": "Système"}
RULE = "=" * 50


def _json_safe(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = fn_iso_timestamp(c)
        out.append(c.alias(f.name))
    return out


def results_json(df: DataFrame, key: str) -> DataFrame:
    """(key, document) -- one JSON document per result row; NaN -> null,
    timestamps ISO, NULL fields kept."""
    body = [c for c in _json_safe(df)]
    return df.select(column(key).cast("string").alias("key"),
                     F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("document"))


def chart_export(viz: DataFrame, id_expr: Column, fields: list[str], analysis: list[str],
                 dataset: list[str]) -> DataFrame:
    """(id, document) for joined chart rows: own fields plus nested parent
    ``analysis`` and ``dataset`` objects."""
    return viz.select(id_expr.alias("id"), F.to_json(F.struct(
        id_expr.alias("id"), *[F.col(f) for f in fields],
        F.struct(*[F.col(a) for a in analysis]).alias("analysis"),
        F.struct(*[F.col(d) for d in dataset]).alias("dataset")), {"ignoreNullFields": "false"}).alias("document"))


def transcript_json(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, line_no, line) JSON lines: a header per session
    ({id, title, n_messages}) then each message ({turn, role, content}) in order."""
    header = (messages.groupBy(F.col(session).alias("session")).agg(F.count(F.lit(1)).alias("n"))
              .select("session", F.lit(-1).cast("bigint").alias("line_no"),
                      F.to_json(F.struct(F.col("session").cast("string").alias("id"),
                                         F.concat(F.lit("Conversation "), F.col("session").cast("string")).alias("title"),
                                         F.col("n").alias("n_messages"))).alias("line")))
    body = messages.select(F.col(session).alias("session"), F.col(order).cast("bigint").alias("line_no"),
                           F.to_json(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"),
                                              F.col(text).alias("content"))).alias("line"))
    return header.unionByName(body)


def _role_display(c: Column) -> Column:
    e = None
    for k, v in ROLE_DISPLAY.items():
        e = F.when(c == k, F.lit(v)) if e is None else e.when(c == k, F.lit(v))
    return e.otherwise(c)


def transcript_txt(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, line_no, line) text lines: ``Conversation: <title>``, a rule,
    then ``<Role>:`` / content / blank per message, in order."""
    sessions = messages.select(F.col(session).alias("session")).distinct()
    head = sessions.select("session", F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"),
                 F.concat(F.lit("Conversation: Conversation "), F.col("session").cast("string")).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit(RULE).alias("line")),
        F.struct(F.lit(3).cast("bigint").alias("line_no"), F.lit("").alias("line")))))
    t = F.col(order).cast("bigint")
    body = messages.select(F.col(session).alias("session"), F.inline(F.array(
        F.struct((t * 3 + 10).alias("line_no"), F.concat(_role_display(F.col(role)), F.lit(":")).alias("line")),
        F.struct((t * 3 + 11).alias("line_no"), F.col(text).alias("line")),
        F.struct((t * 3 + 12).alias("line_no"), F.lit("").alias("line")))))
    return head.unionByName(body)


LINE_ORDER = ["session", "created_at", "message_id", "part"]


def session_transcript_json(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """S10 from ``sessions`` (session, title, created_at, dataset) and ``messages`` (session,
    message_id, role, content, message_type, created_at): JSON lines in the order of LINE_ORDER, a
    session's own line first (its created_at and message_id are NULL). Sessions without messages have a line too;
    messages of one second keep together and are ordered by id."""
    keep = {"ignoreNullFields": "false"}
    head = sessions.select("session", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("message_id"),
                           F.lit(0).alias("part"), F.to_json(F.struct(
                               F.col("session").cast("string").alias("id"), "title", fn_iso_timestamp("created_at").alias("created_at"),
                               "dataset"), keep).alias("line"))
    body = messages.select("session", "created_at", "message_id", F.lit(0).alias("part"), F.to_json(F.struct(
        F.col("message_id").alias("id"), "role", "content", "message_type", fn_iso_timestamp("created_at").alias("created_at")), keep).alias("line"))
    return head.unionByName(body)


def session_transcript_txt(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """S11 from the same tables: the lines ``Conversation:``, ``Date:``, ``Dataset:`` (if there is one), a rule, then
    ``[HH:MM:SS] <Role>:`` / content / blank per message, in the order of LINE_ORDER."""
    def lines(*texts: Column) -> Column:
        return F.inline(F.filter(F.array(*[F.struct(F.lit(i).alias("part"), t.alias("line")) for i, t in enumerate(texts)]),
                                 lambda x: x["line"].isNotNull()))

    day = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    head = sessions.select("session", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("message_id"),
                           lines(F.concat(F.lit("Conversation: "), "title"), F.concat(F.lit("Date: "), day),
                                 F.concat(F.lit("Dataset: "), "dataset"), F.lit(""), F.lit(RULE), F.lit("")))
    said = F.concat(F.lit("["), F.date_format("created_at", "HH:mm:ss"), F.lit("] "), _role_display(F.col("role")), F.lit(":"))
    body = messages.select("session", "created_at", "message_id", lines(said, F.coalesce("content", F.lit("")), F.lit("")))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, fmt: str = "text", order: list[str] | None = None) -> None:
    """Write lines in ``order`` (default session, line_no; LINE_ORDER for session transcripts): range
    partitioning on it keeps each session's lines contiguous and splits a huge session."""
    order = order or ["session", "line_no"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if fmt == "text":
        ordered.select("line").write.mode("overwrite").text(path)
    else:
        ordered.write.mode("overwrite").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Write (key, document) rows as JSON lines."""
    docs.write.mode("overwrite").json(path)
