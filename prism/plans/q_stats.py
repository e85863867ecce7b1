"""Registered queries: correlation (A7-A10) and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from prism.functions.scalar import iso_sql
from prism.operators import correlate as C
from prism.operators import timeseries as TS
from prism.plans.registry import canon_sql as R, register, round_doubles, table

# lineitem with a strong derived pair, a constant and an all-NULL column, and NULLs in l_tax
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net", "l_const", "l_allnull"]
KEPT = [c for c in CORR_COLS if c != "l_const"]
CORR_SRC_SQL = (
    "SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, "
    "l_extendedprice * (1 - l_discount) AS l_net, 1.0::DOUBLE AS l_const, NULL::DOUBLE AS l_allnull FROM lineitem"
)


def corr_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
        F.lit(1.0).alias("l_const"),
        F.lit(None).cast("double").alias("l_allnull"),
    )


def _r(a: str, b: str) -> str:
    if a == b:
        return f"coalesce(CASE WHEN var_pop({a}) > 0 THEN 1.0 END, 0.0)"
    return f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 0.0)"


def _matrix_sql(cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS pos1, '{a}' AS var1, {j + 1} AS pos2, '{b}' AS var2, {_r(a, b)} AS r FROM src"
        for i, a in enumerate(cols) for j, b in enumerate(cols))


@register("drop_constant_columns", f"WITH src AS ({CORR_SRC_SQL}) " + " UNION ALL ".join(
    f"SELECT {i + 1} AS pos, '{c}' AS column_name, count({c}) AS n, (count({c}) >= 2 AND min({c}) = max({c})) AS is_constant FROM src"
    for i, c in enumerate(CORR_COLS)))
def q_drop_constant_columns(spark, sf):
    return C.constant_columns(corr_frame(spark, sf))


@register("correlation_matrix", f"WITH src AS ({CORR_SRC_SQL}), m AS ({_matrix_sql(CORR_COLS)}) "
          f"SELECT pos1, var1, pos2, var2, {R('r')} AS r FROM m")
def q_correlation_matrix(spark, sf):
    return round_doubles(C.correlation_matrix(corr_frame(spark, sf)))


_TOP_SQL = (f"WITH src AS ({CORR_SRC_SQL}), m AS ({_matrix_sql(KEPT)}), "
            "t AS (SELECT row_number() OVER (ORDER BY abs(r) DESC, pos1, pos2) AS rank, var1, var2, r FROM m WHERE pos1 < pos2) ")


@register("top_correlations", _TOP_SQL + f"SELECT rank, var1, var2, {R('r')} AS r FROM t WHERE rank <= 10")
def q_top_correlations(spark, sf):
    return round_doubles(C.correlation_analysis(corr_frame(spark, sf)).top)


@register("correlation_summary", _TOP_SQL + (
    f"SELECT CAST({len(KEPT)} AS BIGINT) AS variables_analyzed, CAST({len(CORR_COLS)} AS BIGINT) AS original_numeric_columns, "
    "CAST(1 AS BIGINT) AS removed_constant_columns, var1 AS strongest_var1, var2 AS strongest_var2, "
    f"{R('r')} AS strongest_r, '{', '.join(KEPT)}' AS analyzed_columns FROM t WHERE rank = 1"))
def q_correlation_summary(spark, sf):
    return round_doubles(C.correlation_summary(corr_frame(spark, sf)))


# 52 derived columns with NULLs in different rows
N_WIDE = 52
_WIDE_SQL = "SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % {i + 3} <> 0 THEN l_quantity * {i % 7 + 1} + l_extendedprice * {i * 7 % 5} / 100 + (l_partkey % {i + 2}) END AS w{i}"
    for i in range(N_WIDE)) + " FROM lineitem"


def wide_frame(spark, sf):
    return table(spark, sf, "lineitem").select(*[
        F.when((F.col("l_orderkey") + i) % (i + 3) != 0, F.col("l_quantity") * (i % 7 + 1) + F.col("l_extendedprice") * (i * 7 % 5) / 100
               + F.col("l_partkey") % (i + 2)).alias(f"w{i}") for i in range(N_WIDE)])


@register("correlation_wide", f"WITH src AS ({_WIDE_SQL}), one AS (SELECT " + ", ".join(
    f"corr(w{i}, w{j}) AS r{i}_{j}" for i in range(N_WIDE) for j in range(i + 1, N_WIDE)) + " FROM src), "
    "long AS (UNPIVOT one ON COLUMNS(*) INTO NAME pair VALUE r) "
    f"SELECT 'w' || split_part(pair[2:], '_', 1) AS var1, 'w' || split_part(pair[2:], '_', 2) AS var2, {R('r')} AS r FROM long")
def q_correlation_wide(spark, sf):
    m = C.correlation_matrix(wide_frame(spark, sf))
    return round_doubles(m.where("pos1 < pos2").select("var1", "var2", "r"))


# names as users have them
ODD_NAMES = {"l_quantity": "chiffre d'affaires", "l_tax": "a.b", "l_discount": "Prix HT"}


@register("odd_names", "WITH src AS (SELECT l_quantity AS \"chiffre d'affaires\", CASE WHEN l_linenumber <> 3 THEN l_tax END AS \"a.b\", "
          "l_discount AS \"Prix HT\" FROM lineitem), n AS (SELECT * FROM (VALUES (1), (2), (3))) " + " UNION ALL ".join(
              f"""SELECT '{c.replace("'", "''")}' AS column_name, count("{c}") AS count, {R(f'avg("{c}")')} AS mean, {R(f'median("{c}")')} AS q50,
  count(DISTINCT "{c}") AS "distinct", count(*) - count("{c}") AS missing, {R(f'corr("{c}", "Prix HT")')} AS r_price FROM src"""
              for c in ODD_NAMES.values()))
def q_odd_names(spark, sf):
    from prism.functions.sqltext import column
    from prism.operators import describe as D
    from prism.operators import roles as RL

    li = corr_frame(spark, sf).select(*[column(c).alias(n) for c, n in ODD_NAMES.items()])
    d = D.describe_numeric(li).select("column_name", "count", "mean", "q50")
    p = RL.column_profile(li).select("column_name", "distinct", "missing")
    m = C.correlation_matrix(li).where(F.col("var2") == "Prix HT").select(F.col("var1").alias("column_name"), F.col("r").alias("r_price"))
    return round_doubles(d.join(p, "column_name").join(m, "column_name"))


def _ts_sql(tab: str, d: str, v: str) -> str:
    return (f"SELECT '{d}' AS date_column, '{v}' AS value_column, {iso_sql(f'min({d})')} AS start, "
            f"{iso_sql(f'max({d})')} AS \"end\", {R(f'avg({v})')} AS mean, {R(f'stddev_samp({v})')} AS std, "
            f"{R(f'min({v})')} AS min, {R(f'max({v})')} AS max, count(*) AS n_observations, NULL::VARCHAR AS message "
            f"FROM {tab} WHERE {d} IS NOT NULL AND {v} IS NOT NULL AND NOT isnan({v})")


@register("timeseries_summary", _ts_sql("events", "ts", "value"))
def q_timeseries_summary(spark, sf):
    return round_doubles(TS.timeseries_summary(table(spark, sf, "events"), "ts", "value"))


@register("timeseries_summary_orders", _ts_sql("orders", "o_orderdate", "o_totalprice"))
def q_timeseries_summary_orders(spark, sf):
    return round_doubles(TS.timeseries_summary(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("timeseries_summary_text_dates", _ts_sql(
    "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_text, o_totalprice FROM orders)", "o_orderdate_text", "o_totalprice")
    .replace("min(o_orderdate_text)", "min(CAST(o_orderdate_text AS TIMESTAMP))")
    .replace("max(o_orderdate_text)", "max(CAST(o_orderdate_text AS TIMESTAMP))"))
def q_timeseries_summary_text(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_text"), "o_totalprice")
    return round_doubles(TS.timeseries_summary(o, "o_orderdate_text", "o_totalprice"))
