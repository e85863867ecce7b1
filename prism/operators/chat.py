"""Message classes and data-driven suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.functions.sqltext import column
from prism.functions.text import classify_type
from prism.operators.roles import roles



def intent_distribution(messages: DataFrame, text: str, by_role: str | None = None) -> DataFrame:
    """Message count per T1 class (optionally per role)."""
    keys = [classify_type(F.col(text)).alias("type")] + ([F.col(by_role)] if by_role else [])
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def role_profile(df: DataFrame, name: str) -> DataFrame:
    """One row (dataset, rows, numeric_columns, categorical_columns, numeric_names,
    categorical_names): the columns, in schema order, whose values differ. A column without
    values or with a single one is of no use to any suggestion. One aggregate."""
    r = roles(df)
    bounds = [x for c in (*r.numeric, *r.categorical) for x in (F.min(column(c)).alias(f"least {c}"), F.max(column(c)).alias(f"most {c}"))]

    def varying(names: list[str]) -> Column:
        kept = [F.when(column(f"least {c}") < column(f"most {c}"), F.lit(c)) for c in names]
        return F.array_compact(F.array(*kept).cast("array<string>"))

    one = df.agg(F.count(F.lit(1)).alias("rows"), *bounds)
    return one.select(F.lit(name).alias("dataset"), "rows", varying(r.numeric).alias("numeric_names"),
                      varying(r.categorical).alias("categorical_names")).select(
        "dataset", "rows", F.size("numeric_names").cast("bigint").alias("numeric_columns"),
        F.size("categorical_names").cast("bigint").alias("categorical_columns"), "numeric_names", "categorical_names")


def _first(codes: list[Column], k: int | None) -> Column:
    given = F.array_compact(F.array(*codes))
    return given if k is None else F.slice(given, 1, k)


def analysis_suggestions(profiles: DataFrame, n_shown: int | None = None) -> DataFrame:
    """T4: (dataset, codes) -- ordered suggestions from a role profile; ``n_shown`` keeps the first."""
    n, c = F.col("numeric_columns"), F.col("categorical_columns")
    codes = [
        F.lit("show_structure"),
        F.when(n >= 2, F.lit("correlations")), F.when(n >= 2, F.lit("outliers")),
        F.when(n >= 1, F.lit("descriptive_stats")),
        F.when(c >= 1, F.lit("category_distribution")),
        F.lit("data_quality"), F.lit("suggest_visualizations"),
    ]
    return profiles.select("dataset", _first(codes, n_shown).alias("codes"))


def chart_suggestions(profiles: DataFrame, n_shown: int | None = None) -> DataFrame:
    """T5: (dataset, codes) -- scatter of the first two numeric columns, correlation
    matrix, histogram of the first numeric, box plot, bar of the first categorical;
    ``n_shown`` keeps the first."""
    n, c = F.col("numeric_columns"), F.col("categorical_columns")
    num, cat = F.col("numeric_names"), F.col("categorical_names")
    codes = [
        F.when(n >= 2, F.concat(F.lit("scatter:"), F.get(num, F.lit(0)), F.lit(" vs "), F.get(num, F.lit(1)))),
        F.when(n >= 2, F.lit("correlation_matrix")),
        F.when(n >= 1, F.concat(F.lit("histogram:"), F.get(num, F.lit(0)))),
        F.when(n >= 1, F.lit("box_outliers")),
        F.when(c >= 1, F.concat(F.lit("bar:"), F.get(cat, F.lit(0)))),
    ]
    return profiles.select("dataset", _first(codes, n_shown).alias("codes"))


def feedback_rollup(messages: DataFrame, role: str, helpful: Column) -> DataFrame:
    """(role, is_helpful, count) -- helpful / not helpful / no feedback per role."""
    return messages.groupBy(F.col(role).alias("role"), helpful.alias("is_helpful")).agg(F.count(F.lit(1)).alias("count"))
