"""Streaming versions of the workspace counters (ST1-ST3).

Each stream keeps its aggregation state in Spark's state store (checkpointed
under the shared folder named by ``spark.checkpoint.dir``, so a lost executor
or a restarted query resumes) and writes every micro-batch's *updated* rows to
``<table>/batch=<id>``. A replayed batch overwrites its own folder, so the sink
is idempotent; the current table is the latest row per key over all batches.
Counters of keys that never end (ST2) keep no state at all: batches write their own counts, which are summed.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from prism.functions.sqltext import column
from prism.session import scratch_path


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``timestamp``: a ``timestamp_ntz`` is read as UTC, whatever the session's zone."""
    if stream.schema[ts].dataType != TimestampNTZType():
        return stream.withColumn(ts, column(ts).cast("timestamp"))
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), column(ts)).cast("timestamp")
    return stream.withColumn(ts, utc)


def utc_day(day: Column) -> Column:
    """A window's start as the UTC time it stands for (``timestamp_ntz``)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), day.cast("timestamp_ntz"))


def stream_daily_counts(stream: DataFrame, ts: str, by: list[str] | None = None, watermark: str = "1 day") -> DataFrame:
    """ST1: per-day (and per ``by``) counts, late data bounded by ``watermark``."""
    s = event_time(stream, ts).withWatermark(ts, watermark)
    keys = [F.window(ts, "1 day").alias("window")] + [F.col(b) for b in (by or [])]
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def interaction_counts(events: DataFrame, item: str, kind: str) -> DataFrame:
    """ST2: (item, type, count) of a batch of events -- replaces read-modify-write ``+= 1``."""
    return events.groupBy(column(item).alias("item"), column(kind).alias("type")).agg(F.count(F.lit(1)).alias("count"))


def stream_status_counts(stream: DataFrame, status: str) -> DataFrame:
    """ST3: running count per status."""
    return stream.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def start_upsert(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    """Run ``agg`` in update mode; each micro-batch's changed rows go to
    ``path/batch=<id>`` (overwrite -> idempotent on replay)."""
    def write_batch(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    w = agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current table of an upsert sink: the row of the latest batch per key, in one scan."""
    data = spark.read.option("basePath", path).parquet(path).drop("batch")
    rest = [c for c in data.columns if c not in (*keys, "_batch")]
    latest = data.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return latest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def compact(spark: SparkSession, path: str, keys: list[str], target: str) -> DataFrame:
    """Write the current table to ``target`` as one batch, which a sink may go on from; the old
    folder can be deleted when no reader uses it. Returns the compacted table."""
    data = spark.read.option("basePath", path).parquet(path)
    last = data.agg(F.max("_batch")).first()[0]
    read_upserts(spark, path, keys).withColumn("_batch", F.lit(last)).write.mode("overwrite").parquet(
        os.path.join(target, f"batch={last}"))
    return read_upserts(spark, target, keys)


def run_to_table(spark: SparkSession, agg: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process everything available now and return the resulting table."""
    base = scratch_path(spark, f"stream-{name}")
    q = start_upsert(agg, os.path.join(base, "table"), os.path.join(base, "checkpoint"), available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_upserts(spark, os.path.join(base, "table"), keys)


def parquet_stream(spark: SparkSession, directory: str, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the parquet files of ``directory`` (optionally those
    matching ``glob``), with the schema of the files already there."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    schema = r.parquet(directory).schema
    s = spark.readStream.schema(schema)
    if glob:
        s = s.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        s = s.option("maxFilesPerTrigger", max_files_per_trigger)
    return s.parquet(directory)


# --- counters without state -------------------------------------------------------------
#: After so many micro-batches their counts are folded into one table.
FOLD_EVERY = 64


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Number -> folder ``<kind>=<number>`` under ``path`` that a finished write has left."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return {int(f.getName().split("=")[1]): f.toString() for f in found
            if f.getName().startswith(f"{kind}=") and fs.exists(done(f, "_SUCCESS"))}


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _totals(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """Totals of the last fold and the batches after it (up to a batch), in one scan."""
    limit = float("inf") if upto is None else upto
    folds = {n: f for n, f in _folders(spark, path, "fold").items() if n <= limit}
    last = max(folds, default=-1)
    parts = ([folds[last]] if folds else []) + [f for n, f in sorted(_folders(spark, path, "batch").items()) if last < n <= limit]
    return spark.read.parquet(*parts).groupBy(*keys).agg(F.sum("count").alias("count")) if parts else None


def start_counters(events: DataFrame, item: str, kind: str, path: str, checkpoint: str, fold_every: int = FOLD_EVERY,
                   available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """ST2 as a stream that keeps no state: each micro-batch's own counts go to ``path/batch=<id>`` (a replayed batch
    overwrites its folder), and after every ``fold_every`` batches all counts so far are folded into
    ``path/fold=<id>``. A key that is idle costs a row of the folded table and nothing in memory, and an event that
    comes late, after whatever time, adds to the right total. Folders that the fold before covers are deleted then: a reader
    that has planned its scan still finds its files while one fold passes."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        interaction_counts(batch, item, kind).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
        if (batch_id + 1) % fold_every == 0:
            folds = _folders(spark, path, "fold")
            before = max((n for n in folds if n < batch_id), default=-1)
            if batch_id not in folds:  # a replayed batch may find its fold made
                _totals(spark, path, ["item", "type"], batch_id).write.mode("overwrite").parquet(os.path.join(path, f"fold={batch_id}"))
            old = [f for n, f in _folders(spark, path, "batch").items() if n <= before]
            _delete(spark, old + [f for n, f in folds.items() if n < before])

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Current (item, type, count) of :func:`start_counters`."""
    totals = _totals(spark, path, ["item", "type"])
    return spark.createDataFrame([], "item string, type string, count long") if totals is None else totals


def count_to_table(spark: SparkSession, events: DataFrame, item: str, kind: str, fold_every: int = FOLD_EVERY) -> DataFrame:
    """Count everything available now and return the resulting table."""
    base = scratch_path(spark, "stream-counters")
    q = start_counters(events, item, kind, os.path.join(base, "table"), os.path.join(base, "checkpoint"), fold_every)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_counters(spark, os.path.join(base, "table"))
