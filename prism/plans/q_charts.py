"""Registered queries: chart data (C1-C10, X14) and result writers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prism.functions.scalar import iso_sql, json_array_sizes
from prism.operators import charts as CH
from prism.operators import correlate as C
from prism.operators import describe as D
from prism.operators.workspace import count_by_type
from prism.plans.fixtures import CUSTOMER_NULLS_SQL, LINEITEM_NULLS_SQL, customer_nulls, lineitem_nulls
from prism.plans.q_profile import (LINEITEM_COLS, LINEITEM_NUMERIC, LINEITEM_TEXT, LINEITEM_TYPES, _describe_sql,
                                   _top_sql, _total_missing_sql)
from prism.plans.q_stats import CORR_SRC_SQL, KEPT, _matrix_sql, corr_frame
from prism.plans.registry import canon, canon_sql as R, register, round_doubles, table
from prism.sources import sinks as S

NCOLS = len(LINEITEM_COLS)
_TM = _total_missing_sql(LINEITEM_COLS, LINEITEM_TYPES)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pos_case(col: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{n}' THEN {i + 1}" for i, n in enumerate(names)) + " END"


# ------------------------------------------------------------- SQL of each chart
_C1 = " UNION ALL ".join(
    f"SELECT 'composition' AS chart, 'doughnut' AS chart_type, 1 AS series_pos, {_q(CH.COMPOSITION_SERIES)} AS series, "
    f"{i + 1} AS label_pos, {_q(lab)} AS label, CAST({v} AS DOUBLE) AS value, NULL::VARCHAR AS color "
    f"FROM (SELECT ({_TM}) AS tm FROM src) a"
    for i, (lab, v) in enumerate(zip(CH.COMPOSITION_LABELS, ["8", "2", "tm"])))
_FIRST6 = _FIRST5 = LINEITEM_NUMERIC
_C2 = " UNION ALL ".join(
    f"SELECT 'five_number', 'radar', {_pos_case('column_name', _FIRST6)}, column_name, {i + 1}, {_q(lab)}, {s}, NULL::VARCHAR "
    f"FROM d WHERE column_name IN ({', '.join(_q(c) for c in _FIRST6)})"
    for i, (lab, s) in enumerate(zip(CH.FIVE_NUMBER_LABELS, ["min", "q25", "median", "q75", "max"])))
_C3 = " UNION ALL ".join(
    f"SELECT 'median_vs_mean', 'bar', {sp}, {_q(name)}, {_pos_case('column_name', _FIRST5)}, column_name, {s}, NULL::VARCHAR "
    f"FROM d WHERE column_name IN ({', '.join(_q(c) for c in _FIRST5)})"
    for sp, name, s in [(1, CH.MEDIAN_SERIES, "median"), (2, CH.MEAN_SERIES, "mean")])


def _c4(cols: list[str]) -> str:
    kind = f"CASE {_pos_case('column_name', cols)} WHEN 1 THEN 'pie' WHEN 2 THEN 'doughnut' WHEN 3 THEN 'polarArea' ELSE 'bar' END"
    totals = " UNION ALL ".join(f"SELECT {_q(c)} AS column_name, count({c}) AS n FROM src" for c in cols)
    return (f"SELECT 'category:' || column_name, {kind}, 1, column_name, CAST(rank AS INTEGER), value, CAST(count AS DOUBLE), NULL::VARCHAR "
            f"FROM t WHERE rank <= 8 UNION ALL SELECT 'category:' || column_name, {kind}, 1, column_name, 9, 'Autres', CAST(n - shown AS DOUBLE), "
            f"NULL::VARCHAR FROM (SELECT o.column_name, o.n, coalesce(sum(t.count), 0) AS shown FROM ({totals}) o LEFT JOIN t "
            "ON t.column_name = o.column_name AND t.rank <= 8 GROUP BY ALL) WHERE n > shown")


_C4 = _c4(LINEITEM_TEXT)
_C5 = (f"SELECT 'completeness', 'pie', 1, 'Valeurs', 1, {_q(CH.COMPLETENESS_LABELS[0])}, CAST(count(*) * {NCOLS} - ({_TM}) AS DOUBLE), "
       f"NULL::VARCHAR FROM src HAVING ({_TM}) > 0 UNION ALL SELECT 'completeness', 'pie', 1, 'Valeurs', 2, "
       f"{_q(CH.COMPLETENESS_LABELS[1])}, CAST({_TM} AS DOUBLE), NULL::VARCHAR FROM src HAVING ({_TM}) > 0")
_DESC_CTES = (f"WITH src AS ({LINEITEM_NULLS_SQL}), d AS ({_describe_sql(LINEITEM_NULLS_SQL, LINEITEM_NUMERIC)}), "
              f"t AS ({_top_sql(LINEITEM_NULLS_SQL, LINEITEM_TEXT)}) ")
_CORR_CTES = (f"WITH src AS ({CORR_SRC_SQL}), m AS ({_matrix_sql(KEPT)}), "
              "top AS (SELECT row_number() OVER (ORDER BY abs(r) DESC, pos1, pos2) AS rank, var1, var2, r FROM m "
              "WHERE pos1 < pos2 QUALIFY rank <= 10) ")
_C6 = (f"SELECT 'top_correlations', 'bar', 1, {_q(CH.CORRELATION_SERIES)}, CAST(rank AS INTEGER), var1 || ' ↔ ' || var2, abs(r), "
       f"CASE WHEN r > 0 THEN '{CH.POSITIVE_COLOR}' ELSE '{CH.NEGATIVE_COLOR}' END FROM top")
_FIRST8 = KEPT
_C7 = (f"SELECT 'correlation_profile', 'radar', 1, {_q(CH.CORRELATION_PROFILE_SERIES)}, {_pos_case('var1', _FIRST8)}, var1, "
       f"avg(abs(r)), NULL::VARCHAR FROM m WHERE var1 <> var2 AND var1 IN ({', '.join(_q(c) for c in _FIRST8)}) "
       f"AND var2 IN ({', '.join(_q(c) for c in _FIRST8)}) GROUP BY var1")


def _rows_sql(ctes: str, body: str) -> str:
    return f"{ctes}, rows(chart, chart_type, series_pos, series, label_pos, label, value, color) AS ({body}) SELECT chart, chart_type, series_pos, series, label_pos, label, {R('value')} AS value, color FROM rows"


def _desc_inputs(spark, sf):
    li = lineitem_nulls(spark, sf)
    return li, D.describe_numeric(li), D.categorical_top10(li)


@register("chart_composition", _rows_sql("WITH src AS (" + LINEITEM_NULLS_SQL + ")", _C1))
def q_chart_composition(spark, sf):
    return round_doubles(CH.chart_composition(lineitem_nulls(spark, sf)))


@register("chart_five_number", _rows_sql(_DESC_CTES[:-1], _C2))
def q_chart_five_number(spark, sf):
    _, d, _ = _desc_inputs(spark, sf)
    return round_doubles(CH.chart_five_number(d, LINEITEM_NUMERIC))


@register("chart_median_vs_mean", _rows_sql(_DESC_CTES[:-1], _C3))
def q_chart_median_vs_mean(spark, sf):
    _, d, _ = _desc_inputs(spark, sf)
    return round_doubles(CH.chart_median_vs_mean(d, LINEITEM_NUMERIC))


@register("chart_category_topk_other", _rows_sql(_DESC_CTES[:-1], _C4))
def q_chart_category_topk_other(spark, sf):
    li = lineitem_nulls(spark, sf)
    return round_doubles(CH.chart_category_topk_other(D.categorical_top10(li), LINEITEM_TEXT, totals=CH.category_totals(li, LINEITEM_TEXT)))


@register("chart_category_topk_other_part", _rows_sql(
    f"WITH src AS (SELECT * FROM part), t AS ({_top_sql('SELECT * FROM part', ['p_name', 'p_brand', 'p_type'])})",
    _c4(["p_name", "p_brand", "p_type"])))
def q_chart_category_topk_other_part(spark, sf):
    part, cols = table(spark, sf, "part"), ["p_name", "p_brand", "p_type"]
    return round_doubles(CH.chart_category_topk_other(D.categorical_top10(part), cols, totals=CH.category_totals(part, cols)))


@register("chart_completeness", _rows_sql("WITH src AS (" + LINEITEM_NULLS_SQL + ")", _C5))
def q_chart_completeness(spark, sf):
    return round_doubles(CH.chart_completeness(lineitem_nulls(spark, sf)))


def _corr(spark, sf):
    return C.correlation_analysis(corr_frame(spark, sf))


@register("chart_top_correlations", _rows_sql(_CORR_CTES[:-1], _C6))
def q_chart_top_correlations(spark, sf):
    return round_doubles(CH.chart_top_correlations(_corr(spark, sf).top))


@register("chart_correlation_profile", _rows_sql(_CORR_CTES[:-1], _C7))
def q_chart_correlation_profile(spark, sf):
    res = _corr(spark, sf)
    return round_doubles(CH.chart_correlation_profile(res.matrix, res.kept))


def _auto_desc(spark, sf):
    li, d, t = _desc_inputs(spark, sf)
    return CH.auto_charts("descriptive", df=li, describe=d, top10=t, numeric_cols=LINEITEM_NUMERIC,
                          categorical_cols=LINEITEM_TEXT)


_AUTO_DESC_BODY = " UNION ALL ".join([_C1, _C2, _C3, _C4, _C5])


@register("auto_charts", _rows_sql(_DESC_CTES[:-1], _AUTO_DESC_BODY))
def q_auto_charts(spark, sf):
    return round_doubles(_auto_desc(spark, sf))


@register("auto_charts_correlation", _rows_sql(_CORR_CTES[:-1], _C6 + " UNION ALL " + _C7))
def q_auto_charts_correlation(spark, sf):
    res = _corr(spark, sf)
    return round_doubles(CH.auto_charts("correlation", top=res.top, matrix=res.matrix, variables=res.kept))


_DOC_SQL = (f"{_DESC_CTES}, rows(chart, chart_type, series_pos, series, label_pos, label, value, color) AS ({_AUTO_DESC_BODY}), "
            "s AS (SELECT chart, chart_type, series_pos, count(*) AS n, sum(value) AS total, arg_min(label, label_pos) AS first_label "
            "FROM rows GROUP BY ALL) "
            "SELECT chart, chart_type, CAST(arg_min(n, series_pos) AS INTEGER) AS points, CAST(count(*) AS INTEGER) AS series, "
            f"arg_min(first_label, series_pos) AS first_label, {R('sum(total)')} AS total FROM s GROUP BY chart, chart_type")


@register("chart_document", _DOC_SQL)
def q_chart_document(spark, sf):
    docs = CH.chart_document(_auto_desc(spark, sf))
    return round_doubles(docs.select(
        "chart", "chart_type", F.size("document.labels").alias("points"), F.size("document.datasets").alias("series"),
        F.col("document.labels")[0].alias("first_label"),
        F.aggregate(F.flatten(F.transform("document.datasets", lambda d: d["data"])), F.lit(0.0),
                    lambda a, x: a + canon(x)).alias("total")))


@register("json_array_sizes", f"{_DESC_CTES}, rows(chart, chart_type, series_pos, series, label_pos, label, value, color) AS ({_AUTO_DESC_BODY}) SELECT chart, "
          "CAST(count(DISTINCT label_pos) AS INTEGER) AS points, CAST(count(DISTINCT series_pos) AS INTEGER) AS series "
          "FROM rows GROUP BY chart")
def q_json_array_sizes(spark, sf):
    docs = CH.chart_document(_auto_desc(spark, sf)).select("chart", F.to_json("document").alias("doc"))
    return docs.select("chart", json_array_sizes("doc").alias("s")).select("chart", "s.points", "s.series")


# Documents derived from events; a broken variant per event type.
_VALID_DOC = """'{"labels": ["' || event_type || '"], "datasets": [{"label": "v", "data": [' || CAST(event_id AS VARCHAR) || ']}]}'"""


def _doc_sql() -> str:
    return ("CASE event_type "
            """WHEN 'error' THEN '{"datasets": [{"data": [1]}]}' """
            """WHEN 'view' THEN '{"labels": [], "datasets": []}' """
            """WHEN 'click' THEN '{"labels": ["a"], "datasets": [{"data": 5}]}' """
            """WHEN 'purchase' THEN '[1, 2, 3]' """
            f"ELSE {_VALID_DOC} END")


@register("chart_validate", f"""SELECT event_id AS id,
  coalesce(json_type(doc, '$.labels') = 'ARRAY' AND coalesce(json_array_length(doc, '$.datasets'), 0) > 0
    AND json_type(doc) = 'OBJECT'
    AND list_bool_and(list_transform(CAST(json_extract(doc, '$.datasets[*]') AS JSON[]), lambda d: json_type(d, '$.data') = 'ARRAY')),
    false) AS is_valid
FROM (SELECT event_id, {_doc_sql()} AS doc FROM events)""")
def q_chart_validate(spark, sf):
    ev = table(spark, sf, "events")
    doc = (F.when(F.col("event_type") == "error", F.lit('{"datasets": [{"data": [1]}]}'))
           .when(F.col("event_type") == "view", F.lit('{"labels": [], "datasets": []}'))
           .when(F.col("event_type") == "click", F.lit('{"labels": ["a"], "datasets": [{"data": 5}]}'))
           .when(F.col("event_type") == "purchase", F.lit("[1, 2, 3]"))
           .otherwise(F.concat(F.lit('{"labels": ["'), F.col("event_type"), F.lit('"], "datasets": [{"label": "v", "data": ['),
                               F.col("event_id").cast("string"), F.lit("]}]}"))))
    d = ev.select(F.col("event_id").alias("id"), doc.alias("doc"))
    return d.select("id", CH.chart_validate(d, "doc").alias("is_valid"))


@register("chart_custom", "SELECT 'events by type' AS chart, 'bar' AS chart_type, true AS is_valid, "
          "CAST(count(DISTINCT event_type) AS INTEGER) AS points FROM events")
def q_chart_custom(spark, sf):
    counts = count_by_type(table(spark, sf, "events"), "event_type")
    rows = counts.select(F.lit("events").alias("series"), F.dense_rank().over(Window.orderBy("value")).alias("label_pos"),
        F.col("value").alias("label"), F.col("count").alias("value"))
    out = CH.chart_custom(rows, "events by type", "bar")
    return out.select("chart", "chart_type", "is_valid",
                      F.json_array_length(F.get_json_object("doc", "$.labels")).alias("points"))


# ---------------------------------------------------------------- S8-S11
@register("results_json", f"SELECT column_name AS key, count, mean, std, q50 FROM ({_describe_sql(CUSTOMER_NULLS_SQL, ['c_custkey', 'c_nationkey', 'c_acctbal'])})")
def q_results_json(spark, sf):
    desc = round_doubles(D.describe_numeric(customer_nulls(spark, sf)))
    docs = S.results_json(desc, "column_name")
    j = F.col("document")
    return docs.select("key", F.get_json_object(j, "$.count").cast("bigint").alias("count"),
                       F.get_json_object(j, "$.mean").cast("double").alias("mean"),
                       F.get_json_object(j, "$.std").cast("double").alias("std"),
                       F.get_json_object(j, "$.q50").cast("double").alias("q50"))


@register("chart_export", """SELECT concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber) AS id,
  l.l_returnflag AS chart_type, o.o_orderkey AS analysis_id, o.o_orderpriority AS analysis_type, p.p_name AS dataset_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""")
def q_chart_export(spark, sf):
    li, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    viz = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    ids = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    docs = S.chart_export(viz, ids, ["l_returnflag"], ["o_orderkey", "o_orderpriority"], ["p_partkey", "p_name"])
    j = F.col("document")
    return docs.select("id", F.get_json_object(j, "$.l_returnflag").alias("chart_type"),
                       F.get_json_object(j, "$.analysis.o_orderkey").cast("bigint").alias("analysis_id"),
                       F.get_json_object(j, "$.analysis.o_orderpriority").alias("analysis_type"),
                       F.get_json_object(j, "$.dataset.p_name").alias("dataset_name"))


@register("transcript_json", """
SELECT conv_id AS session, CAST(-1 AS BIGINT) AS line_no,
       CAST(to_json({'id': CAST(conv_id AS VARCHAR), 'title': 'Conversation ' || CAST(conv_id AS VARCHAR), 'n_messages': count(*)}) AS VARCHAR) AS line
FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, turn, CAST(to_json({'turn': turn, 'role': role, 'content': text}) AS VARCHAR) FROM conversations""")
def q_transcript_json(spark, sf):
    return S.transcript_json(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@register("transcript_txt", """
WITH s AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS session, CAST(0 AS BIGINT) AS line_no, 'Conversation: Conversation ' || CAST(conv_id AS VARCHAR) AS line FROM s
UNION ALL SELECT conv_id, 1, '' FROM s
UNION ALL SELECT conv_id, 2, repeat('=', 50) FROM s
UNION ALL SELECT conv_id, 3, '' FROM s
UNION ALL SELECT conv_id, turn * 3 + 10, CASE role WHEN 'user' THEN 'Utilisateur' WHEN 'assistant' THEN 'Assistant'
  WHEN 'system' THEN 'Système' ELSE role END || ':' FROM conversations
UNION ALL SELECT conv_id, turn * 3 + 11, text FROM conversations
UNION ALL SELECT conv_id, turn * 3 + 12, '' FROM conversations""")
def q_transcript_txt(spark, sf):
    return S.transcript_txt(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


# orders stand in for the sessions (every third without a dataset), lineitem for their messages
_SESSIONS_SQL = ("SELECT o_orderkey AS session, 'Analyse ' || o_orderpriority AS title, o_orderdate AS created_at, "
                 "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS dataset FROM orders")
_MESSAGES_SQL = ("SELECT l_orderkey AS session, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS message_id, "
                 "CASE l_linestatus WHEN 'O' THEN 'user' ELSE 'assistant' END AS role, l_returnflag AS content, "
                 "CASE WHEN l_linenumber > 1 THEN 'text' END AS message_type, l_shipdate AS created_at FROM lineitem")


def _session_tables(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sessions = o.select(F.col("o_orderkey").alias("session"), F.concat(F.lit("Analyse "), "o_orderpriority").alias("title"),
                        F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("dataset"))
    messages = li.select(F.col("l_orderkey").alias("session"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("message_id"),
                         F.when(F.col("l_linestatus") == "O", "user").otherwise("assistant").alias("role"), F.col("l_returnflag").alias("content"),
                         F.when(F.col("l_linenumber") > 1, "text").alias("message_type"), F.col("l_shipdate").alias("created_at"))
    return sessions, messages


@register("session_transcript_json", f"""
WITH s AS ({_SESSIONS_SQL}), m AS ({_MESSAGES_SQL})
SELECT session, NULL::TIMESTAMP AS created_at, NULL::VARCHAR AS message_id, 0 AS part,
       CAST(to_json({{'id': CAST(session AS VARCHAR), 'title': title, 'created_at': {iso_sql('created_at')}, 'dataset': dataset}}) AS VARCHAR) AS line FROM s
UNION ALL
SELECT session, created_at, message_id, 0,
       CAST(to_json({{'id': message_id, 'role': role, 'content': content, 'message_type': message_type, 'created_at': {iso_sql('created_at')}}}) AS VARCHAR) FROM m""")
def q_session_transcript_json(spark, sf):
    return S.session_transcript_json(*_session_tables(spark, sf))


@register("session_transcript_txt", f"""
WITH s AS ({_SESSIONS_SQL}), m AS ({_MESSAGES_SQL}),
h AS (SELECT session, NULL::TIMESTAMP AS created_at, NULL::VARCHAR AS message_id,
             unnest(['Conversation: ' || title, 'Date: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'Dataset: ' || dataset, '', repeat('=', 50), '']) AS line,
             unnest(range(6)) AS part FROM s),
b AS (SELECT session, created_at, message_id,
             unnest(['[' || strftime(created_at, '%H:%M:%S') || '] ' || CASE role WHEN 'user' THEN 'Utilisateur' ELSE 'Assistant' END || ':', content, '']) AS line,
             unnest(range(3)) AS part FROM m)
SELECT session, created_at, message_id, part::INTEGER AS part, line FROM (SELECT * FROM h UNION ALL SELECT * FROM b) WHERE line IS NOT NULL""")
def q_session_transcript_txt(spark, sf):
    return S.session_transcript_txt(*_session_tables(spark, sf))


# ---------------------------------------------------------------- charts without a computation in the reference
def _hist_frame(spark, sf):
    return table(spark, sf, "lineitem")


@register("chart_histogram", f"""
WITH mm AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - mn) * 10.0 / (mx - mn)) + 1, 10) AS INTEGER) AS b, mn, mx FROM lineitem, mm)
SELECT 'histogram:l_extendedprice' AS chart, 'bar' AS chart_type, 1 AS series_pos, 'l_extendedprice' AS series,
       b AS label_pos, printf('%.2f', any_value(mn) + (b - 1) * (any_value(mx) - any_value(mn)) / 10) AS label,
       {R('count(*)')} AS value, NULL::VARCHAR AS color FROM b GROUP BY b""")
def q_chart_histogram(spark, sf):
    out = CH.chart_histogram(_hist_frame(spark, sf), "l_extendedprice", 10)
    return round_doubles(out)


@register("outlier_fences", f"WITH d AS ({_describe_sql(LINEITEM_NULLS_SQL, LINEITEM_NUMERIC)}), src AS ({LINEITEM_NULLS_SQL}) "
          + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, {R('q25 - 1.5 * (q75 - q25)')} AS lower, {R('q75 + 1.5 * (q75 - q25)')} AS upper, "
              f"(SELECT count_if({c} < d.q25 - 1.5 * (d.q75 - d.q25) OR {c} > d.q75 + 1.5 * (d.q75 - d.q25)) FROM src) AS n_outliers "
              f"FROM d WHERE column_name = '{c}'" for c in LINEITEM_NUMERIC))
def q_outlier_fences(spark, sf):
    li = lineitem_nulls(spark, sf)
    return round_doubles(CH.outlier_fences(li, D.describe_numeric(li)))


_HASH_SQL = "(l_orderkey * 2654435761 + l_linenumber * 40503 + l_partkey) % 1000003"


@register("chart_scatter_sample", f"""
SELECT 'scatter:l_quantity:l_extendedprice' AS chart, 'scatter' AS chart_type, 1 AS series_pos,
       'l_quantity vs l_extendedprice' AS series, CAST(NULL AS INTEGER) AS label_pos, CAST(l_quantity AS VARCHAR) AS label,
       {R('l_extendedprice')} AS value, NULL::VARCHAR AS color
FROM (SELECT * FROM lineitem ORDER BY {_HASH_SQL}, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 500)""")
def q_chart_scatter_sample(spark, sf):
    li = table(spark, sf, "lineitem")
    h = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_linenumber") * 40503 + F.col("l_partkey")) % 1000003
    order = F.struct(h.alias("h"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return round_doubles(CH.chart_scatter_sample(li, "l_quantity", "l_extendedprice", order, 500))


@register("chart_heatmap", f"WITH src AS ({CORR_SRC_SQL}), m AS ({_matrix_sql(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_net', 'l_const', 'l_allnull'])}) "
          f"SELECT 'heatmap' AS chart, 'heatmap' AS chart_type, pos1 AS series_pos, var1 AS series, pos2 AS label_pos, var2 AS label, "
          f"{R('r')} AS value, NULL::VARCHAR AS color FROM m")
def q_chart_heatmap(spark, sf):
    return round_doubles(CH.chart_heatmap(C.correlation_matrix(corr_frame(spark, sf))))


@register("chart_box", _rows_sql(_DESC_CTES[:-1], _C2.replace("'five_number', 'radar'", "'box', 'boxplot'").replace(
    ", ".join(_q(c) for c in _FIRST6), ", ".join(_q(c) for c in _FIRST5)).replace(
    _pos_case('column_name', _FIRST6), _pos_case('column_name', _FIRST5))))
def q_chart_box(spark, sf):
    _, d, _ = _desc_inputs(spark, sf)
    return round_doubles(CH.chart_box(d, LINEITEM_NUMERIC))


@register("chart_line", "SELECT 'daily' AS chart, 'line' AS chart_type, 1 AS series_pos, 'count' AS series, "
          "CAST(dense_rank() OVER (ORDER BY day) AS INTEGER) AS label_pos, CAST(day AS VARCHAR) AS label, "
          "CAST(count AS DOUBLE) AS value, NULL::VARCHAR AS color FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS count "
          "FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY GROUP BY 1)")
def q_chart_line(spark, sf):
    from prism.operators.workspace import daily_counts
    from prism.plans.fixtures import EVENTS_ASOF
    return CH.chart_line(daily_counts(table(spark, sf, "events"), "ts", EVENTS_ASOF, 30), "day", "count", "daily")
