"""Registered queries: scalar functions (X1-X15) and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from prism.functions import scalar as X
from prism.functions.text import (CLASS_INFO, EXPLORATION_WORDS, VISUALIZATION_WORDS, classify_message,
                                  classify_message_degraded)
from prism.operators import chat as T
from prism.operators.joins import preset_eligibility
from prism.plans.q_workspace import PROFILE_TABLES, _class_sql
from prism.plans.registry import canon_sql as R, register, round_doubles, table

LI_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_ID_SQL = ", ".join(LI_ID)


# ---------------------------------------------------------------- X1-X15
@register("fn_percentage", f"SELECT {LI_ID_SQL}, "
          f"{R('coalesce(round(l_quantity / CASE WHEN l_linenumber - 1 <> 0 THEN l_linenumber - 1 END * 100, 2), 0.0)')} AS pct "
          "FROM lineitem")
def q_fn_percentage(spark, sf):
    li = table(spark, sf, "lineitem")
    return round_doubles(li.select(*LI_ID, X.fn_percentage(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("pct")))


@register("fn_multiply", f"SELECT {LI_ID_SQL}, {R('l_quantity * l_discount')} AS product FROM lineitem")
def q_fn_multiply(spark, sf):
    li = table(spark, sf, "lineitem")
    return round_doubles(li.select(*LI_ID, X.fn_multiply("l_quantity", "l_discount").alias("product")))


@register("fn_concat", f"SELECT {LI_ID_SQL}, CAST(l_linenumber AS VARCHAR) || l_returnflag AS label FROM lineitem")
def q_fn_concat(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_ID, X.fn_concat("l_linenumber", "l_returnflag").alias("label"))


@register("fn_map_get", "SELECT event_id, json_extract_string(props, '$.k') AS k_text, "
          "CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS INTEGER) AS absent FROM events")
def q_fn_map_get(spark, sf):
    ev = table(spark, sf, "events")
    m = F.from_json("props", "map<string,int>")
    return ev.select("event_id", X.fn_json_get("props", "k").alias("k_text"), X.fn_map_get(m, "k").alias("k"),
                     X.fn_map_get(m, "absent").alias("absent"))


_TAGS_SQL = "p_brand || ', ' || p_type || ',,' || replace(p_name, ' ', ', ') || ' '"
_SPLIT_SQL = f"list_filter(list_transform(string_split({_TAGS_SQL}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _tags(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat("p_brand", F.lit(", "), "p_type", F.lit(",,"),
                                          F.regexp_replace("p_name", " ", ", "), F.lit(" ")).alias("tags"))


@register("tags_split", f"SELECT p_partkey, array_to_string({_SPLIT_SQL}, '|') AS tags, CAST(len({_SPLIT_SQL}) AS INTEGER) AS n_tags FROM part")
def q_tags_split(spark, sf):
    t = _tags(spark, sf).select("p_partkey", X.tags_split("tags").alias("a"))
    return t.select("p_partkey", F.array_join("a", "|").alias("tags"), F.size("a").alias("n_tags"))


@register("tags_join", f"SELECT p_partkey, array_to_string({_SPLIT_SQL}, ', ') AS tags FROM part")
def q_tags_join(spark, sf):
    return _tags(spark, sf).select("p_partkey", X.tags_join(X.tags_split("tags")).alias("tags"))


@register("tags_overflow", f"SELECT p_partkey, array_to_string({_SPLIT_SQL}[1:3], '|') AS shown, "
          f"CAST(greatest(len({_SPLIT_SQL}) - 3, 0) AS INTEGER) AS rest FROM part")
def q_tags_overflow(spark, sf):
    t = _tags(spark, sf).select("p_partkey", X.tags_overflow(X.tags_split("tags"), 3).alias("o"))
    return t.select("p_partkey", F.array_join("o.shown", "|").alias("shown"), F.col("o.rest").alias("rest"))


@register("fn_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 99) || '…' ELSE text END AS excerpt "
          "FROM documents")
def q_fn_truncate(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.fn_truncate("text", 100).alias("excerpt"))


@register("title_from_message", """
SELECT conv_id AS session,
       substr(arg_min(text, turn), 1, 50) || CASE WHEN length(arg_min(text, turn)) > 50 THEN '...' ELSE '' END AS title
FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def q_title_from_message(spark, sf):
    from prism.operators.listing import first_user_message
    first = first_user_message(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return first.select("session", X.title_from_message(F.lit(X.DEFAULT_TITLE), F.col("text")).alias("title"))


_TITLE_SRC = ("CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderstatus = 'O' THEN 'Nouvelle conversation' "
              "ELSE o_orderpriority END")


@register("default_title", f"SELECT o_orderkey, CASE WHEN ({_TITLE_SRC}) = '' OR ({_TITLE_SRC}) = 'Nouvelle conversation' "
          f"THEN 'Analyse de ' || CAST(o_custkey AS VARCHAR) ELSE {_TITLE_SRC} END AS title FROM orders")
def q_default_title(spark, sf):
    o = table(spark, sf, "orders")
    src = (F.when(F.col("o_orderstatus") == "F", F.lit("")).when(F.col("o_orderstatus") == "O", F.lit(X.DEFAULT_TITLE))
           .otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", X.default_title(src, F.col("o_custkey")).alias("title"))


def _human_sql(b: str) -> str:
    nb = "chr(160)"
    parts = [f"WHEN {b} = 1 THEN '1' || {nb} || 'byte'", f"WHEN {b} < 1024 THEN CAST(CAST({b} AS BIGINT) AS VARCHAR) || {nb} || 'bytes'"]
    for k, u in enumerate(X.SIZE_UNITS, start=1):
        cond = f"{b} < {float(1024 ** (k + 1))}" if u != X.SIZE_UNITS[-1] else "TRUE"
        parts.append(f"WHEN {cond} THEN printf('%.1f', round_even({b} / {float(1024 ** k)}, 1)) || {nb} || '{u}'")
    return "CASE " + " ".join(parts) + " END"


@register("fn_human_bytes", f"SELECT doc_id, {_human_sql('CAST(strlen(text) AS DOUBLE)')} AS text_size, "
          f"{_human_sql('CAST(n_chars * 4096 * 1024 AS DOUBLE)')} AS scaled_size FROM documents")
def q_fn_human_bytes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.fn_human_bytes(F.octet_length("text")).alias("text_size"),
                    X.fn_human_bytes(F.col("n_chars") * 4096 * 1024).alias("scaled_size"))


@register("fn_default_dash", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '—') AS quality FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_fn_default_dash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", X.fn_default_dash("quality").alias("quality"))


@register("fn_iso_timestamp", f"SELECT event_id, {X.iso_sql('ts')} AS iso, strftime(ts, '%H:%M:%S') AS clock, "
          "strftime(ts, '%d/%m/%Y %H:%M') AS display FROM events")
def q_fn_iso_timestamp(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", X.fn_iso_timestamp("ts").alias("iso"), X.fn_iso_timestamp("ts", "HH:mm:ss").alias("clock"),
                     X.fn_iso_timestamp("ts", "dd/MM/yyyy HH:mm").alias("display"))


@register("fn_json_pretty", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")
def q_fn_json_pretty(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", X.fn_json_pretty("props", "k INT").alias("props"))


# ---------------------------------------------------------------- T1-T6
def _info_sql(k: int, text: str) -> str:
    return "CASE " + " ".join(f"WHEN ({_class_sql(text)}) = '{name}' THEN '{info[k]}'" for name, info in CLASS_INFO.items()) + " END"


@register("classify_message", f"SELECT conv_id, turn, {_class_sql('text')} AS type, {_info_sql(0, 'text')} AS intent, "
          f"{_info_sql(1, 'text')} AS suggested_approach, {_info_sql(2, 'text')} AS complexity FROM conversations")
def q_classify_message(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", classify_message(F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


@register("classify_message_documents", f"SELECT doc_id, {_class_sql('text')} AS type FROM documents")
def q_classify_message_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", classify_message(F.col("text"))["type"].alias("type"))


def _degraded_sql(text: str) -> str:
    def any_word(ws):
        return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in ws) + ")"
    return (f"CASE WHEN {any_word(EXPLORATION_WORDS)} THEN 'data_exploration' "
            f"WHEN {any_word(VISUALIZATION_WORDS)} THEN 'visualization' ELSE 'help' END")


@register("classify_message_degraded", f"SELECT conv_id, turn, {_degraded_sql('text')} AS type FROM conversations")
def q_classify_message_degraded(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", classify_message_degraded(F.col("text")).alias("type"))


@register("intent_distribution", f"SELECT {_class_sql('text')} AS type, role, count(*) AS count FROM conversations GROUP BY 1, 2")
def q_intent_distribution(spark, sf):
    return T.intent_distribution(table(spark, sf, "conversations"), "text", by_role="role")


# Profiles of the tables (schema order), shared by T4 / T5 twins.
_PROFILES = {
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                 ["l_returnflag", "l_linestatus"]),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
    "customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
    "events": (["event_id", "user_id", "value"], ["event_type", "props"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source"]),
    "labels": (["doc_id", "quality", "toxic"], []),
    "conversations": (["conv_id", "turn"], ["role", "text"]),
}


def _profiles(spark, sf):
    out = None
    for t in PROFILE_TABLES:
        p = T.role_profile(table(spark, sf, t), t)
        out = p if out is None else out.unionByName(p)
    return out


def _varying_sql(t: str) -> str:
    """One row: the names of the columns of a table whose values differ, by role."""
    def names(cols):
        return "[" + ", ".join(f"CASE WHEN min({c}) < max({c}) THEN '{c}' END" for c in cols) + "]::VARCHAR[]"
    num, cat = _PROFILES[t]
    keep = "list_filter({}, lambda x: x IS NOT NULL)"
    return f"SELECT '{t}' AS dataset, {keep.format(names(num))} AS num, {keep.format(names(cat))} AS cat FROM {t}"


_VARYING = "WITH p AS (" + " UNION ALL ".join(_varying_sql(t) for t in PROFILE_TABLES) + ") "


def _suggest_sql(kind: str) -> str:
    if kind == "analysis":
        codes = ["'show_structure'", "CASE WHEN len(num) >= 2 THEN 'correlations' END", "CASE WHEN len(num) >= 2 THEN 'outliers' END",
                 "CASE WHEN len(num) >= 1 THEN 'descriptive_stats' END", "CASE WHEN len(cat) >= 1 THEN 'category_distribution' END",
                 "'data_quality'", "'suggest_visualizations'"]
    else:
        codes = ["CASE WHEN len(num) >= 2 THEN 'scatter:' || num[1] || ' vs ' || num[2] END",
                 "CASE WHEN len(num) >= 2 THEN 'correlation_matrix' END", "CASE WHEN len(num) >= 1 THEN 'histogram:' || num[1] END",
                 "CASE WHEN len(num) >= 1 THEN 'box_outliers' END", "CASE WHEN len(cat) >= 1 THEN 'bar:' || cat[1] END"]
    return _VARYING + f"SELECT dataset, concat_ws('|', {', '.join(codes)}) AS codes FROM p"


@register("analysis_suggestions", _suggest_sql("analysis"))
def q_analysis_suggestions(spark, sf):
    return T.analysis_suggestions(_profiles(spark, sf)).select("dataset", F.array_join("codes", "|").alias("codes"))


@register("chart_suggestions", _suggest_sql("chart"))
def q_chart_suggestions(spark, sf):
    return T.chart_suggestions(_profiles(spark, sf)).select("dataset", F.array_join("codes", "|").alias("codes"))


# The preset catalogue (name, least numeric columns, least categorical columns).
PRESETS = [
    ("overview", 0, 0), ("distribution", 1, 0), ("correlation", 2, 0), ("regression", 2, 0),
    ("clustering", 2, 0), ("categories", 0, 1), ("segment_compare", 1, 1), ("full_report", 3, 2),
]


@register("preset_eligibility", _VARYING + """, pre(preset, n, c) AS (VALUES ('overview', 0, 0), ('distribution', 1, 0),
  ('correlation', 2, 0), ('regression', 2, 0), ('clustering', 2, 0), ('categories', 0, 1), ('segment_compare', 1, 1), ('full_report', 3, 2))
SELECT dataset, preset FROM p JOIN pre ON len(num) >= n AND len(cat) >= c""")
def q_preset_eligibility(spark, sf):
    presets = spark.createDataFrame(PRESETS, "preset string, min_numeric_columns int, min_categorical_columns int")
    return preset_eligibility(_profiles(spark, sf), presets).select("dataset", "preset")


@register("feedback_rollup", "SELECT d.lang AS role, l.quality = 1 AS is_helpful, count(*) AS count FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def q_feedback_rollup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return T.feedback_rollup(d, "lang", F.col("quality") == 1)
