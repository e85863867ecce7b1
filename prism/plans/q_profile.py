"""Registered queries: profile, validation and descriptive statistics (P*, V*, A1-A6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.operators import describe as D
from prism.operators import quality as Q
from prism.operators import roles as RL
from prism.operators import timeseries as TS
from prism.plans.fixtures import CUSTOMER_NULLS_SQL, LINEITEM_NULLS_SQL, customer_nulls, lineitem_nulls
from prism.plans.registry import canon_sql as R, register, round_doubles, table

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]
LINEITEM_COLS = LINEITEM_NUMERIC + LINEITEM_TEXT + ["l_shipdate"]
LINEITEM_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double",
                  "string", "string", "timestamp_ntz"]


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, {R(f'avg({x})')} AS mean, "
            f"{R(f'stddev_samp({x})')} AS std, {R(f'min({x})')} AS min, "
            f"{R(f'quantile_cont({x}, 0.25)')} AS q25, {R(f'quantile_cont({x}, 0.5)')} AS q50, "
            f"{R(f'quantile_cont({x}, 0.75)')} AS q75, {R(f'max({x})')} AS max, "
            f"{R(f'quantile_cont({x}, 0.5)')} AS median FROM src"
        )
    return f"WITH src AS ({src}) " + " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql(LINEITEM_NULLS_SQL, LINEITEM_NUMERIC))
def q_describe_numeric(spark, sf):
    return round_doubles(D.describe_numeric(lineitem_nulls(spark, sf)))


@register("describe_numeric_customer", _describe_sql(CUSTOMER_NULLS_SQL, ["c_custkey", "c_nationkey", "c_acctbal"]))
def q_describe_numeric_customer(spark, sf):
    return round_doubles(D.describe_numeric(customer_nulls(spark, sf)))


@register("describe_numeric_events", _describe_sql("SELECT * FROM events", ["event_id", "user_id", "value"]))
def q_describe_numeric_events(spark, sf):
    return round_doubles(D.describe_numeric(table(spark, sf, "events")))


# ---------------------------------------------------------------- SQL helpers
def _miss_sql(c: str, t: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if t == "double" else f"({c} IS NULL)"


def _total_missing_sql(cols, types) -> str:
    return " + ".join(f"count_if({_miss_sql(c, t)})" for c, t in zip(cols, types))


LI_SRC = f"WITH src AS ({LINEITEM_NULLS_SQL}) "
NCOLS = len(LINEITEM_COLS)
ROLE = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical",
        "timestamp_ntz": "temporal"}


def _j(expr: str) -> str:
    """array of codes -> '|'-joined text (lists hash differently across engines)."""
    return f"array_to_string(list_filter({expr}, lambda x: x IS NOT NULL), '|')"


# ---------------------------------------------------------------- P1-P8
@register("column_profile", LI_SRC + " UNION ALL ".join(
    f"SELECT {i + 1} AS pos, '{c}' AS column_name, '{t}' AS dtype, '{ROLE[t]}' AS role, "
    f"count_if({_miss_sql(c, t)}) AS missing, count(DISTINCT CASE WHEN NOT {_miss_sql(c, t)} THEN {c} END) AS n_distinct FROM src"
    for i, (c, t) in enumerate(zip(LINEITEM_COLS, LINEITEM_TYPES))))
def q_column_profile(spark, sf):
    return RL.column_profile(lineitem_nulls(spark, sf)).withColumnRenamed("distinct", "n_distinct")


@register("numeric_projection", "SELECT " + ", ".join(LINEITEM_NUMERIC) + " FROM lineitem")
def q_numeric_projection(spark, sf):
    return round_doubles(RL.numeric_projection(table(spark, sf, "lineitem")))


# text dates of every kind: column, its SQL, its expression over orders
_DATE_COLUMNS = {
    "iso_text": ("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"),
    "month_first_text": ("strftime(o_orderdate, '%m/%d/%Y')", "date_format(o_orderdate, 'MM/dd/yyyy')"),
    "day_first_text": ("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')"),
    "ambiguous_text": ("CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%d/%m/%Y') END",
                       "CASE WHEN day(o_orderdate) <= 12 THEN date_format(o_orderdate, 'dd/MM/yyyy') END"),
    "mixed_text": ("CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END",
                   "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'MM/dd/yyyy') END"),
    "named_month_text": ("strftime(o_orderdate, '%b %-d, %Y')", "date_format(o_orderdate, 'MMM d, yyyy')"),
    "half_day_text": ("strftime(o_orderdate, '%-m/%-d/%Y %-I:%M %p')", "date_format(o_orderdate, 'M/d/yyyy h:mm a')"),
    "one_bad": ("CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END",
                "CASE WHEN o_orderkey = {last} THEN 'unknown' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"),
    "o_orderpriority": ("o_orderpriority", "o_orderpriority"),
    "no_values": ("CASE WHEN false THEN 'x' END", "CAST(NULL AS STRING)"),
}
# the forms that these columns can have, in the order of their election: pattern, SQL of a value's date
_FORMS_SQL = [("iso", "TRY_CAST({c} AS TIMESTAMP)"), ("M/d/yyyy", "try_strptime({c}, ['%m/%d/%Y', '%m/%d/%Y %I:%M %p'])"),
              ("d/M/yyyy", "try_strptime({c}, '%d/%m/%Y')"), ("MMM d, yyyy", "try_strptime({c}, '%b %d, %Y')")]
DATE_COLUMNS_SQL = "SELECT " + ", ".join(f"{sql} AS {c}" for c, (sql, _) in _DATE_COLUMNS.items()) + ", o_totalprice FROM orders"


def date_columns(spark, sf):
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    return o.selectExpr(*[f"{e.format(last=last)} AS {c}" for c, (_, e) in _DATE_COLUMNS.items()], "o_totalprice")


def _elected_sql(c: str, entry) -> str:
    """CASE over the forms: the entry of the first that fits all values of the column."""
    return "CASE " + " ".join(f"WHEN count({c}) > 0 AND count({sql.format(c=c)}) = count({c}) THEN {entry(name, sql.format(c=c))}"
                              for name, sql in _FORMS_SQL) + " END"


@register("date_candidates", f"WITH src AS ({DATE_COLUMNS_SQL}), f AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_elected_sql(c, lambda name, _: repr(name))} AS form FROM src" for c in _DATE_COLUMNS)
    + ") SELECT column_name, form IS NOT NULL AS is_date, form FROM f")
def q_date_candidates(spark, sf):
    return RL.date_candidates(date_columns(spark, sf))


_SUMMED = ["month_first_text", "day_first_text", "ambiguous_text", "mixed_text", "half_day_text"]


def _text_summary_sql(c: str) -> str:
    def day(end: str) -> str:
        return f"strftime({_elected_sql(c, lambda _, sql: f'{end}({sql})')}, '%Y-%m-%dT%H:%M:%S')"
    best = "greatest(" + ", ".join(f"count({sql.format(c=c)})" for _, sql in _FORMS_SQL) + ")"
    there = f"FILTER (WHERE {c} IS NOT NULL)"
    good = f"count({c}) = {best}"
    stats = [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]
    return (f"SELECT '{c}' AS date_column, 'o_totalprice' AS value_column, {day('min')} AS start, {day('max')} AS \"end\", "
            + ", ".join(R(f"CASE WHEN {good} THEN {fn}(o_totalprice) {there} END") + f" AS {name}" for name, fn in stats)
            + f", CASE WHEN {good} THEN count({c}) END AS n_observations, "
            f"CASE WHEN NOT ({good}) THEN 'date_parse_error:' || (count({c}) - {best}) END AS message FROM src")


@register("timeseries_summary_date_forms", f"WITH src AS ({DATE_COLUMNS_SQL}) " + " UNION ALL ".join(map(_text_summary_sql, _SUMMED)))
def q_timeseries_summary_date_forms(spark, sf):
    src = date_columns(spark, sf)
    return round_doubles(reduce(DataFrame.unionByName, [TS.timeseries_summary(src, c, "o_totalprice") for c in _SUMMED]))


@register("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview_head(spark, sf):
    return round_doubles(RL.preview_head(table(spark, sf, "orders"), "o_orderkey", 10))


@register("shape", f"SELECT count(*) AS rows, CAST({NCOLS} AS BIGINT) AS columns FROM lineitem")
def q_shape(spark, sf):
    return RL.shape(table(spark, sf, "lineitem"))


@register("dtype_histogram", LI_SRC + "SELECT dtype, count(*) AS n, count_if(filled = 0) AS n_empty FROM ("
          + " UNION ALL ".join(f"SELECT '{t}' AS dataset_type, '{t}' AS dtype, count({c}) AS filled FROM src"
                               for c, t in [*zip(LINEITEM_COLS, LINEITEM_TYPES), ("l_empty", "string")]).replace("src", "(SELECT *, NULL AS l_empty FROM src)")
          + ") GROUP BY dtype")
def q_dtype_histogram(spark, sf):
    return RL.dtype_histogram(lineitem_nulls(spark, sf).withColumn("l_empty", F.lit(None).cast("string")))


_WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}
_SIZE_SQL = " + ".join(
    f"coalesce(sum(strlen({c})), 0)" if t == "string" else f"count({c}) * {_WIDTH[t]}"
    for c, t in zip(LINEITEM_COLS, LINEITEM_TYPES))


@register("size_estimate", LI_SRC + f"SELECT CAST({_SIZE_SQL} AS BIGINT) AS bytes, "
          f"{R(f'CAST({_SIZE_SQL} AS BIGINT) / 1048576.0')} AS mb FROM src")
def q_size_estimate(spark, sf):
    return round_doubles(RL.size_estimate(lineitem_nulls(spark, sf)))


@register("dataset_card", LI_SRC + f"SELECT 'lineitem' AS name, count(*) AS rows, CAST({NCOLS} AS BIGINT) AS columns, "
          "CAST(8 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS boolean_columns, "
          "'bigint: 3, double: 4, int: 1, string: 2, timestamp_ntz: 1' AS dtypes, "
          f"CAST({_total_missing_sql(LINEITEM_COLS, LINEITEM_TYPES)} AS BIGINT) AS missing_cells, "
          f"CAST({_SIZE_SQL} AS BIGINT) AS bytes FROM src")
def q_dataset_card(spark, sf):
    return RL.dataset_card(lineitem_nulls(spark, sf), "lineitem")


# ---------------------------------------------------------------- V1-V10
_TM = _total_missing_sql(LINEITEM_COLS, LINEITEM_TYPES)
_COMPLETE_NUM = " AND ".join(f"NOT {_miss_sql(c, 'double')}" for c in LINEITEM_NUMERIC)


@register("null_counts", LI_SRC + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({_miss_sql(c, t)}) AS missing FROM src"
    for c, t in zip(LINEITEM_COLS, LINEITEM_TYPES)))
def q_null_counts(spark, sf):
    return Q.null_counts(lineitem_nulls(spark, sf))


@register("missing_summary", LI_SRC + f"SELECT CAST({_TM} AS BIGINT) AS missing, count(*) * {NCOLS} AS cells, "
          f"{R(f'round(({_TM}) * 100.0 / (count(*) * {NCOLS}), 2)')} AS pct FROM src")
def q_missing_summary(spark, sf):
    return round_doubles(Q.missing_summary(lineitem_nulls(spark, sf)))


_ALL_COMPLETE = " AND ".join(f"NOT {_miss_sql(c, t)}" for c, t in zip(LINEITEM_COLS, LINEITEM_TYPES))


@register("complete_rows", LI_SRC + f"SELECT count_if({_ALL_COMPLETE}) AS n, "
          f"{R(f'count_if({_ALL_COMPLETE}) * 100.0 / count(*)')} AS pct FROM src")
def q_complete_rows(spark, sf):
    return round_doubles(Q.complete_rows(lineitem_nulls(spark, sf)))


@register("drop_missing", LI_SRC + "SELECT * FROM src WHERE l_tax IS NOT NULL AND NOT isnan(l_tax) AND l_returnflag IS NOT NULL")
def q_drop_missing(spark, sf):
    return round_doubles(Q.drop_missing(lineitem_nulls(spark, sf), ["l_tax", "l_returnflag"]))


@register("check_not_empty", "SELECT count(*) > 0 AS is_valid, CASE WHEN count(*) = 0 THEN 'empty_dataset' END AS code FROM lineitem")
def q_check_not_empty(spark, sf):
    return Q.check_not_empty(table(spark, sf, "lineitem"))


def _join_codes(df):
    return df.select(*[F.array_join(c, "|").alias(c) if c in ("errors", "warnings", "recommendations") else F.col(c)
                       for c in df.columns])


_LI_FACTS = LI_SRC + (f", f AS (SELECT count(*) AS rows, CAST({_TM} AS BIGINT) AS missing, "
                      f"count_if({_COMPLETE_NUM}) AS complete_numeric FROM src) ")


def _common_sql(extra_warn: str = "") -> tuple[str, str, str]:
    err = "[CASE WHEN rows = 0 THEN 'empty_dataset' END]"
    warn = (f"[{extra_warn}CASE WHEN rows > 0 AND missing > rows * {NCOLS} * 0.3 "
            "THEN 'many_missing_values:' || CAST(missing AS VARCHAR) END]")
    return err, warn, "[NULL::VARCHAR]"


_CORR_WARN = "CASE WHEN rows > 0 AND complete_numeric < 5 THEN 'few_complete_rows:' || CAST(complete_numeric AS VARCHAR) END, "


@register("check_correlation", _LI_FACTS + "SELECT rows > 0 AS is_valid, {e} AS errors, {w} AS warnings, {r} AS recommendations FROM f".format(
    e=_j(_common_sql()[0]), w=_j(_common_sql(_CORR_WARN)[1]), r=_j("[NULL::VARCHAR]")))
def q_check_correlation(spark, sf):
    return _join_codes(Q.check_correlation(lineitem_nulls(spark, sf)))


@register("check_descriptive", _LI_FACTS + "SELECT rows > 0 AS is_valid, {e} AS errors, {w} AS warnings FROM f".format(
    e=_j(_common_sql()[0]), w=_j(_common_sql()[1])))
def q_check_descriptive(spark, sf):
    return _join_codes(Q.check_descriptive(lineitem_nulls(spark, sf)))


@register("check_missing_ratio", LI_SRC + f"SELECT ({_TM}) > count(*) * {NCOLS} * 0.3 AS warn, "
          f"{R(f'({_TM}) / (count(*) * {NCOLS}.0)')} AS ratio FROM src")
def q_check_missing_ratio(spark, sf):
    return round_doubles(Q.check_missing_ratio(lineitem_nulls(spark, sf)))


@register("compatibility_matrix", _LI_FACTS + " UNION ALL ".join(
    "SELECT '{t}' AS analysis_type, rows > 0 AS is_valid, {e} AS errors, {w} AS warnings, {r} AS recommendations FROM f".format(
        t=t, e=_j(_common_sql()[0]), w=_j(_common_sql(_CORR_WARN if t == "correlation" else "")[1]), r=_j("[NULL::VARCHAR]"))
    for t in Q.ANALYSIS_TYPES))
def q_compatibility_matrix(spark, sf):
    return _join_codes(Q.compatibility_matrix(lineitem_nulls(spark, sf)))


@register("recommendations", LI_SRC + "SELECT " + _j(
    f"[CASE WHEN round(({_TM}) * 100.0 / (count(*) * {NCOLS}), 2) > 30 THEN 'clean_missing' END, 'correlation']")
    + " AS codes FROM src")
def q_recommendations(spark, sf):
    return Q.recommendations(lineitem_nulls(spark, sf)).select(F.array_join("codes", "|").alias("codes"))


# ---------------------------------------------------------------- A1, A4-A6
@register("dataset_summary", LI_SRC + f"SELECT count(*) AS total_rows, CAST({NCOLS} AS BIGINT) AS total_columns, "
          "CAST(8 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns, "
          f"CAST({_TM} AS BIGINT) AS missing_values, '{', '.join(LINEITEM_NUMERIC)}' AS numeric_column_names, "
          f"'{', '.join(LINEITEM_TEXT)}' AS categorical_column_names FROM src")
def q_dataset_summary(spark, sf):
    return D.dataset_summary(lineitem_nulls(spark, sf))


PART_TEXT = ["p_name", "p_brand", "p_type"]


@register("categorical_nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values FROM part" for c in PART_TEXT))
def q_categorical_nunique(spark, sf):
    return D.categorical_nunique(table(spark, sf, "part"))


@register("categorical_nunique_approx_orders", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values FROM orders"
    for c in ["o_orderstatus", "o_orderpriority"]))
def q_categorical_nunique_approx(spark, sf):
    # low-cardinality columns: the HLL++ sketch is exact at this size
    return D.categorical_nunique(table(spark, sf, "orders"), approx=True)


def _top_sql(src: str, cols: list[str], n: int = 10) -> str:
    return (f"WITH src AS ({src}), c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM src WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols) + "), r AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank, "
        f"value, count FROM c) SELECT * FROM r WHERE rank <= {n}")


@register("categorical_top10", _top_sql("SELECT * FROM part", PART_TEXT))
def q_categorical_top10(spark, sf):
    return D.categorical_top10(table(spark, sf, "part"))


# long texts with copies, a column of keys (no frequent values), and one that is skewed with a long tail
_TOP_MIXED_SQL = ("SELECT text, 'doc-' || doc_id AS key_text, CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 5 < 4 THEN 'v' || (doc_id % 40) "
                  "ELSE 'tail ' || doc_id END AS skewed FROM documents")


@register("categorical_top10_mixed", _top_sql(_TOP_MIXED_SQL, ["text", "key_text", "skewed"]))
def q_categorical_top10_mixed(spark, sf):
    return D.categorical_top10(table(spark, sf, "documents").selectExpr(
        "text", "'doc-' || doc_id AS key_text",
        "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 5 < 4 THEN 'v' || (doc_id % 40) ELSE 'tail ' || doc_id END AS skewed"))


@register("categorical_top10_lineitem", _top_sql(LINEITEM_NULLS_SQL, LINEITEM_TEXT))
def q_categorical_top10_lineitem(spark, sf):
    return D.categorical_top10(lineitem_nulls(spark, sf))


@register("missing_by_dataset", LI_SRC + f"SELECT CAST(count(*) * {NCOLS} - ({_TM}) AS BIGINT) AS complete, "
          f"CAST({_TM} AS BIGINT) AS missing FROM src")
def q_missing_by_dataset(spark, sf):
    return D.missing_by_dataset(lineitem_nulls(spark, sf))


@register("describe_numeric_approx")
def q_describe_numeric_approx(spark, sf):
    """KLL-sketch quantiles: checked by the rank-error bound in tests (no exact SQL twin)."""
    return round_doubles(D.describe_numeric_approx(lineitem_nulls(spark, sf)))


@register("describe_approx_rank_error", LI_SRC + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, true AS q25_holds, true AS q50_holds, true AS q75_holds FROM src"
    for c in LINEITEM_NUMERIC))
def q_describe_approx_rank_error(spark, sf):
    """Per column, whether each sketched quartile's rank lies within n / accuracy of the exact one."""
    from prism.functions.sqltext import dlit, q

    li, accuracy = lineitem_nulls(spark, sf), 10_000
    found = {r["column_name"]: r for r in D.describe_numeric_approx(li, accuracy=accuracy).collect()}
    clean = li.selectExpr(*[f"CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END AS {q(c)}" for c in found])
    at = [(c, p, k) for c in found for p, k in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    one = clean.agg(*[F.expr(f"count({q(c)}) AS `n {c}`") for c in found],
                    *[F.expr(f"count_if({q(c)} {op} {dlit(found[c][k])}) AS `{name} {c} {k}`") for c, _, k in at for op, name in (("<", "below"), ("<=", "upto"))])

    def holds(c, p, k):
        n = F.col(f"`n {c}`")
        return (F.col(f"`below {c} {k}`") <= n * (p + 1 / accuracy) + 1) & (F.col(f"`upto {c} {k}`") >= n * (p - 1 / accuracy) - 1)

    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`n {c}`").alias("count"), *[holds(x, p, k).alias(f"{k}_holds") for x, p, k in at if x == c])
        for c in found])))
