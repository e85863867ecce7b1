"""Registered queries: workspace roll-ups, joins, lists, windows, feed
(A12-A23, J1-J8, F1-F7, W1-W5, U1) on the stand-in tables of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import functions as F

from prism.functions.text import classify_type
from prism.operators import joins as J
from prism.operators import listing as L
from prism.operators import workspace as WS
from prism.plans.fixtures import EVENTS_ASOF, ORDERS_ASOF
from prism.plans.registry import canon_sql as R, register, round_doubles, table

EV_ASOF = f"TIMESTAMP '{EVENTS_ASOF}'"
OR_ASOF = f"TIMESTAMP '{ORDERS_ASOF}'"
STATUS = {"completed": "F", "running": "O", "failed": "P"}
LI_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _class_sql(text: str) -> str:
    """SQL twin of the T1 type rule."""
    from prism.functions.text import ANALYSIS_WORDS, EXPLORATION_WORDS, VISUALIZATION_WORDS

    def any_word(ws):
        return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in ws) + ")"

    return (f"CASE WHEN {any_word(VISUALIZATION_WORDS)} THEN 'visualization' "
            f"WHEN {any_word(EXPLORATION_WORDS)} THEN 'data_exploration' "
            f"WHEN {any_word(ANALYSIS_WORDS)} THEN 'data_analysis' ELSE 'general_question' END")


# ---------------------------------------------------------------- A12-A23
@register("global_sums", "SELECT coalesce(sum(l_quantity), 0) AS sum_l_quantity, "
          "CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS sum_l_linenumber FROM lineitem")
def q_global_sums(spark, sf):
    return round_doubles(WS.global_sums(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"]))


@register("count_by_type", "SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1")
def q_count_by_type(spark, sf):
    return WS.count_by_type(table(spark, sf, "lineitem"), "l_returnflag")


@register("count_by_type_events", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def q_count_by_type_events(spark, sf):
    return WS.count_by_type(table(spark, sf, "events"), "event_type")


@register("status_counts", "SELECT " + ", ".join(f"count_if(o_orderstatus = '{v}') AS {k}" for k, v in STATUS.items())
          + " FROM orders")
def q_status_counts(spark, sf):
    return WS.status_counts(table(spark, sf, "orders"), "o_orderstatus", STATUS)


@register("status_counts_by_owner", "SELECT o_custkey, " + ", ".join(
    f"count_if(o_orderstatus = '{v}') AS {k}" for k, v in STATUS.items()) + " FROM orders GROUP BY o_custkey")
def q_status_counts_by_owner(spark, sf):
    return WS.status_counts(table(spark, sf, "orders"), "o_orderstatus", STATUS, by="o_custkey")


@register("workspace_counts", """
SELECT c.c_custkey AS owner,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n_analyses,
       CAST(coalesce(v.n, 0) AS BIGINT) AS n_visualizations,
       CAST(coalesce(e.n, 0) AS BIGINT) AS n_events
FROM customer c
LEFT JOIN (SELECT o_custkey AS owner, count(*) AS n FROM orders GROUP BY 1) a ON a.owner = c.c_custkey
LEFT JOIN (SELECT o.o_custkey AS owner, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1) v
       ON v.owner = c.c_custkey
LEFT JOIN (SELECT user_id AS owner, count(*) AS n FROM events GROUP BY 1) e ON e.owner = c.c_custkey""")
def q_workspace_counts(spark, sf):
    orders, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return WS.workspace_counts(table(spark, sf, "customer"), "c_custkey", {
        "n_analyses": (orders, "o_custkey"),
        "n_visualizations": WS.counts_via_parent(li, "l_orderkey", orders, "o_orderkey", "o_custkey", "n_visualizations"),
        "n_events": (table(spark, sf, "events"), "user_id"),
    })


@register("recent_activity_counts", f"SELECT user_id AS owner, count_if(ts >= {EV_ASOF} - INTERVAL 7 DAY) AS n_recent "
          "FROM events GROUP BY 1")
def q_recent_activity_counts(spark, sf):
    return WS.recent_activity_counts(table(spark, sf, "events"), "user_id", "ts", EVENTS_ASOF, 7)


@register("active_days", f"SELECT user_id AS owner, count(DISTINCT CAST(ts AS DATE)) AS days_active FROM events "
          f"WHERE ts >= {EV_ASOF} - INTERVAL 30 DAY GROUP BY 1")
def q_active_days(spark, sf):
    return WS.active_days(table(spark, sf, "events"), "user_id", "ts", EVENTS_ASOF, 30)


@register("daily_counts", f"SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events "
          f"WHERE ts >= {EV_ASOF} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 1")
def q_daily_counts(spark, sf):
    return WS.daily_counts(table(spark, sf, "events"), "ts", EVENTS_ASOF, 30)


@register("monthly_activity", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS count "
          "FROM orders GROUP BY 1 ORDER BY 1")
def q_monthly_activity(spark, sf):
    return WS.monthly_activity(table(spark, sf, "orders"), "o_orderdate")


_ROLLUP_SQL = ("SELECT o.o_orderkey AS session, max(l.l_shipdate) AS last_ts, count(l.l_orderkey) AS n "
               "FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")


def _rollup(spark, sf):
    return WS.session_rollup(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@register("session_rollup", _ROLLUP_SQL)
def q_session_rollup(spark, sf):
    return _rollup(spark, sf)


@register("avg_per_session", f"SELECT {R('(SELECT count(*) FROM lineitem) / greatest((SELECT count(*) FROM orders), 1)')} AS avg_messages_per_session")
def q_avg_per_session(spark, sf):
    return round_doubles(WS.avg_per_session(table(spark, sf, "lineitem"), table(spark, sf, "orders")))


@register("chat_stats", "SELECT (SELECT count(*) FROM documents) AS total_sessions, "  # documents stand in for the sessions
          "count(DISTINCT CASE WHEN role = 'user' AND conv_id IN (SELECT doc_id FROM documents) THEN conv_id END) AS active_sessions, count(*) AS total_messages, "
          f"count_if(role = 'user' AND ({_class_sql('text')}) IN ('data_analysis', 'data_exploration')) AS analysis_messages "
          "FROM conversations")
def q_chat_stats(spark, sf):
    c = table(spark, sf, "conversations")
    return WS.chat_stats(c, "conv_id", "role", classify_type(F.col("text")), table(spark, sf, "documents"), "doc_id")


@register("session_counters", "SELECT conv_id AS session, count(*) AS message_count, "
          f"count_if(role = 'user' AND ({_class_sql('text')}) IN ('data_analysis', 'data_exploration')) AS analysis_count "
          "FROM conversations GROUP BY 1")
def q_session_counters(spark, sf):
    c = table(spark, sf, "conversations")
    return WS.session_counters(c, "conv_id", "role", classify_type(F.col("text")))


# ---------------------------------------------------------------- J1-J8
OWNER = 7


@register("join_owner_filter", "SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
          f"WHERE o.o_custkey = {OWNER}")
def q_join_owner_filter(spark, sf):
    return round_doubles(J.join_owner_filter(table(spark, sf, "lineitem"), table(spark, sf, "orders"),
                                             "l_orderkey", "o_orderkey", "o_custkey", OWNER))


@register("join_star", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, o.o_custkey, "
          "o.o_orderpriority, p.p_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
          "JOIN part p ON l.l_partkey = p.p_partkey")
def q_join_star(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_ID, "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return J.join_star(li, [(o, "l_orderkey", "o_orderkey"), (p, "l_partkey", "p_partkey")]).select(
        *LI_ID, "l_returnflag", "o_custkey", "o_orderpriority", "p_name")


@register("join_three_hop_filter", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, c.c_name, n.n_name "
          "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey "
          "JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_7'")
def q_join_three_hop_filter(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_ID)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.join_three_hop_filter(li, [(o, "l_orderkey", "o_orderkey"), (c, "o_custkey", "c_custkey"),
                                        (n, "c_nationkey", "n_nationkey")], F.col("n_name") == "NATION_7").select(
        *LI_ID, "c_name", "n_name")


@register("left_join_rollup", "SELECT o.o_orderkey AS key, count(l.l_orderkey) AS n, max(l.l_shipdate) AS max_ts "
          "FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def q_left_join_rollup(spark, sf):
    return J.left_join_rollup(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@register("left_join_optional", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_left_join_optional(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return J.left_join_optional(d, table(spark, sf, "labels"), "doc_id")


@register("related_items", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, g.n - 1 AS n_related "
          "FROM lineitem l JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) g USING (l_orderkey)")
def q_related_items(spark, sf):
    return J.related_counts(table(spark, sf, "lineitem"), "l_orderkey", LI_ID[1:]).select(
        *LI_ID, "n_related")


@register("related_items_lookup", """
WITH req AS (SELECT * FROM lineitem ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC LIMIT 1)
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber FROM lineitem l JOIN req r ON l.l_orderkey = r.l_orderkey
WHERE NOT (l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey AND l.l_linenumber = r.l_linenumber)""")
def q_related_items_lookup(spark, sf):
    li = table(spark, sf, "lineitem")
    req = li.orderBy(*[F.col(c).desc() for c in LI_ID]).limit(1)
    return J.related_items(li, "l_orderkey", LI_ID[1:], req).select(*LI_ID)


@register("similar_items", """
WITH p AS (
  SELECT a.o_orderkey, b.o_orderkey AS similar_id,
         row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS rank
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
  WHERE a.o_orderkey <> b.o_orderkey)
SELECT o_orderkey, similar_id, rank FROM p WHERE rank <= 4""")
def q_similar_items(spark, sf):
    return J.similar_items(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey",
                           [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 4)


PROFILE_TABLES = ["lineitem", "orders", "customer", "part", "events", "documents", "labels", "conversations"]


# ---------------------------------------------------------------- F1-F7
@register("filter_equals", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def q_filter_equals(spark, sf):
    return round_doubles(L.filter_equals(table(spark, sf, "lineitem"), l_returnflag="R", l_linestatus="F"))


@register("search_one", "SELECT * FROM part WHERE contains(lower(p_name), 'gear')")
def q_search_one(spark, sf):
    return round_doubles(L.search_one(table(spark, sf, "part"), "p_name", "GeAr"))


@register("search_any", "SELECT * FROM part WHERE contains(lower(p_name), 'promo') OR contains(lower(p_brand), 'promo') "
          "OR contains(lower(p_type), 'promo')")
def q_search_any(spark, sf):
    return round_doubles(L.search_any(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "Promo"))


@register("filter_since", f"SELECT * FROM events WHERE ts >= {EV_ASOF} - INTERVAL 7 DAY")
def q_filter_since(spark, sf):
    return round_doubles(L.filter_since(table(spark, sf, "events"), "ts", EVENTS_ASOF, 7))


@register("sort_allowlist", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def q_sort_allowlist(spark, sf):
    s = L.sort_allowlist(table(spark, sf, "part"), "-p_retailprice", ["p_name", "p_retailprice", "p_size"],
                         [F.col("p_partkey").desc()], ["p_partkey"])
    return round_doubles(s.limit(20))


@register("page", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 12 OFFSET 24")
def q_page(spark, sf):
    o = table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey"))
    return round_doubles(L.page(o, 3, 12))


_BROWSER_SQL = """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_returnflag, p.p_name, p.p_brand
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag = 'R' AND (contains(lower(p.p_name), 'red') OR contains(lower(p.p_brand), 'red'))
ORDER BY l.l_quantity DESC, l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber LIMIT 15 OFFSET 15"""


def _browser(spark, sf, **paging):
    li = table(spark, sf, "lineitem").select(*LI_ID, "l_quantity", "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    viz = li.join(p, li["l_partkey"] == p["p_partkey"]).drop("p_partkey")
    return L.visualization_browser(
        viz, type_col="l_returnflag", type_value="R", search_cols=["p_name", "p_brand"], search="Red",
        parent_col="l_orderkey", parent=None, sort="-l_quantity", allowed=["l_quantity", "p_name"],
        default=["-l_orderkey"], key=LI_ID, size=15, **paging)


@register("visualization_browser", _BROWSER_SQL)
def q_visualization_browser(spark, sf):
    return round_doubles(_browser(spark, sf, number=2))


@register("visualization_browser_after", _BROWSER_SQL)
def q_visualization_browser_after(spark, sf):
    """The second page by the key of the first one's last row."""
    first = _browser(spark, sf).collect()
    after = [first[-1][c] for c in ["l_quantity", *LI_ID]] if first else None
    return round_doubles(_browser(spark, sf, after=after))


# ---------------------------------------------------------------- W1-W5
@register("recent_per_owner", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank
FROM orders) WHERE rank <= 5""")
def q_recent_per_owner(spark, sf):
    return round_doubles(L.recent_per_owner(table(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"], 5))


@register("last_messages", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations)
WHERE rank <= 10""")
def q_last_messages(spark, sf):
    return L.last_messages(table(spark, sf, "conversations"), "conv_id", "turn", 10)


@register("first_user_message", "SELECT conv_id AS session, arg_min(text, turn) AS text FROM conversations "
          "WHERE role = 'user' GROUP BY 1")
def q_first_user_message(spark, sf):
    return L.first_user_message(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@register("last_user_message", "SELECT conv_id AS session, arg_max(text, turn) AS text FROM conversations "
          "WHERE role = 'user' GROUP BY 1")
def q_last_user_message(spark, sf):
    return L.last_user_message(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@register("recent_sessions_by_activity", f"SELECT * FROM ({_ROLLUP_SQL}) ORDER BY last_ts DESC NULLS LAST, session LIMIT 10")
def q_recent_sessions_by_activity(spark, sf):
    return L.recent_sessions_by_activity(_rollup(spark, sf), 10)


# ---------------------------------------------------------------- U1
_FEED_SRC = """
WITH a AS (SELECT o_custkey AS owner, o_orderkey AS item_id, o_orderpriority AS title, o_orderstatus AS description,
                  o_orderdate AS ts, 'analysis' AS kind,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders),
     d AS (SELECT user_id AS owner, event_id AS item_id, event_type AS title, props AS description, ts, 'dataset' AS kind,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events),
     u AS (SELECT * FROM a WHERE r <= 5 UNION ALL SELECT * FROM d WHERE r <= 3),
     f AS (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, kind, item_id) AS rank,
                  item_id, title, description, ts, kind FROM u)
SELECT * FROM f WHERE rank <= 8"""


@register("activity_feed", _FEED_SRC)
def q_activity_feed(spark, sf):
    a = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("description"), F.col("o_orderdate").alias("ts"))
    d = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("item_id"), F.col("event_type").alias("title"),
        F.col("props").alias("description"), "ts")
    return L.activity_feed(a, d)


@register("recent_activity", f"SELECT c_custkey AS owner, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= {OR_ASOF} - INTERVAL 90 DAY) AS n_orders, "
          f"(SELECT count(*) FROM events WHERE user_id = c_custkey AND ts >= {EV_ASOF} - INTERVAL 90 DAY) AS n_events FROM customer")
def q_recent_activity(spark, sf):
    return WS.recent_activity(table(spark, sf, "customer"), "c_custkey", {
        "n_orders": (table(spark, sf, "orders"), "o_custkey", "o_orderdate", ORDERS_ASOF),
        "n_events": (table(spark, sf, "events"), "user_id", "ts", EVENTS_ASOF)}, days=90)


@register("page_after", "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01', 100) "
          "ORDER BY o_orderdate, o_orderkey LIMIT 15")
def q_page_after(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return L.page_after(o, ["o_orderdate", "o_orderkey"], ["1998-01-01 00:00:00", 100], 15)
