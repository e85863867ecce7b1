"""Registered queries: readers (S1, S3, S5-S7) and streams (ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prism.plans.registry import register, round_doubles, table
from prism.session import scratch_path
from prism.sources import readers as RD
from prism.sources import xlsx as XL
from prism.streaming import counters as ST


def _csv_copy(spark, sf, name):
    """Write a driver table as CSV (header row) into the shared folder."""
    path = scratch_path(spark, f"{name}-csv")
    table(spark, sf, name).write.mode("overwrite").option("header", True).csv(path)
    return path


@register("scan_csv", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey "
          "FROM nation")
def q_scan_csv(spark, sf):
    return RD.scan_csv(spark, _csv_copy(spark, sf, "nation"))


@register("scan_csv_customer", "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer")
def q_scan_csv_customer(spark, sf):
    return round_doubles(RD.scan_csv(spark, _csv_copy(spark, sf, "customer")))


def _xlsx_copy(spark, sf, name):
    """Write a driver table as workbooks into the shared folder."""
    path = scratch_path(spark, f"{name}-xlsx")
    XL.write_xlsx(table(spark, sf, name), path)
    return path


@register("scan_xlsx", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def q_scan_xlsx(spark, sf):
    return RD.load(spark, _xlsx_copy(spark, sf, "nation"), "excel")


@register("scan_xlsx_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders")
def q_scan_xlsx_orders(spark, sf):
    return round_doubles(RD.load(spark, _xlsx_copy(spark, sf, "orders"), "excel"))


@register("scan_json_records", "SELECT * FROM region")
def q_scan_json_records(spark, sf):
    path = scratch_path(spark, "region-json")
    RD.write_json_records(table(spark, sf, "region"), path)
    return RD.scan_json_records(spark, path, "r_regionkey int, r_name string")


@register("scan_json_columns", "SELECT * FROM nation")
def q_scan_json_columns(spark, sf):
    path = scratch_path(spark, "nation-json-columns")
    RD.write_json_columns(table(spark, sf, "nation"), path)
    return RD.scan_json_columns(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("format_dispatch", "SELECT * FROM part")
def q_format_dispatch(spark, sf):
    path = scratch_path(spark, "part-json")
    RD.write_json_records(table(spark, sf, "part"), path)
    return round_doubles(RD.load(spark, path, "json").select(
        F.col("p_partkey").cast("bigint"), "p_name", "p_brand", "p_type", F.col("p_size").cast("int"), "p_retailprice"))


@register("ingest_metadata", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def q_ingest_metadata(spark, sf):
    return RD.ingest_metadata(spark, f"{sf}/lineitem.parquet").select("rows", "columns")  # bytes: tests/test_sources.py


@register("ingest_metadata_csv", "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders")
def q_ingest_metadata_csv(spark, sf):
    return RD.ingest_metadata(spark, _csv_copy(spark, sf, "orders"), "csv").select("rows", "columns")


def _quoted(spark, sf):
    """Documents with quotes, separators and line ends in a text field, as CSV with doubled quotes."""
    path = scratch_path(spark, "documents-csv")
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit('"'), "text", F.lit('", he said,\n10D')).alias("quoted"), F.concat("doc_id", F.lit("D")).alias("code"))
    d.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@register("scan_csv_quoted", "SELECT doc_id, '\"' || text || '\", he said,' || chr(10) || '10D' AS quoted, doc_id || 'D' AS code FROM documents")
def q_scan_csv_quoted(spark, sf):
    return RD.scan_csv(spark, _quoted(spark, sf))


@register("scan_parquet", "SELECT * FROM nation")
def q_scan_parquet(spark, sf):
    return RD.scan_parquet(spark, f"{sf}/nation.parquet")


# ---------------------------------------------------------------- streams
@register("stream_daily_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS count "
          "FROM events GROUP BY 1, 2")
def q_stream_daily_counts(spark, sf):
    s = ST.parquet_stream(spark, sf, "events.parquet")
    out = ST.run_to_table(spark, ST.stream_daily_counts(s, "ts", ["event_type"]), ["window", "event_type"], "daily")
    return out.select(ST.utc_day(F.col("window.start")).alias("window_start"), "event_type", "count")


@register("stream_interaction_counters", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS item, event_type AS type, "
          "count(*) AS count FROM events GROUP BY 1, 2")
def q_stream_interaction_counters(spark, sf):
    s = ST.parquet_stream(spark, sf, "events.parquet").withColumn(
        "item", F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k")))
    return ST.count_to_table(spark, s, "item", "event_type")


@register("stream_status_counts", "SELECT o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1")
def q_stream_status_counts(spark, sf):
    s = ST.parquet_stream(spark, sf, "orders.parquet")
    return ST.run_to_table(spark, ST.stream_status_counts(s, "o_orderstatus"), ["status"], "status")
