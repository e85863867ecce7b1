"""Data quality and validation.

Validation results carry stable codes (``code`` or ``code:detail``) instead of
the reference's French sentences. Every check is an expression over one
aggregate row of facts, so validating all analysis types costs one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.functions.missing import is_missing
from prism.operators.describe import total_missing_expr
from prism.operators.roles import roles

ANALYSIS_TYPES = ["descriptive", "correlation", "regression", "clustering"]
MISSING_LIMIT = 0.3


def null_counts(df: DataFrame) -> DataFrame:
    """V1: (column_name, missing) per column, one aggregate."""
    fields = df.schema.fields
    one = df.agg(*[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, f in enumerate(fields)
    ])))


def missing_summary(df: DataFrame) -> DataFrame:
    """V2: (missing, cells, pct) with pct = missing / cells * 100 rounded to 2 (NULL for 0 cells)."""
    ncols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), total_missing_expr(df).alias("missing")).select(
        "missing",
        (F.col("rows") * F.lit(ncols)).cast("bigint").alias("cells"),
        F.round(F.try_divide(F.col("missing"), F.col("rows") * F.lit(ncols)) * 100, 2).alias("pct"),
    )


def _complete_row(df: DataFrame, cols: list[str] | None = None) -> Column:
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    cond = F.lit(True)
    for f in fields:
        cond = cond & ~is_missing(f.name, f.dataType)
    return cond


def complete_rows(df: DataFrame) -> DataFrame:
    """V3: (n, pct) rows without any missing cell."""
    return df.agg(F.count_if(_complete_row(df)).alias("n"), F.count(F.lit(1)).alias("rows")).select(
        "n", (F.try_divide(F.col("n"), F.col("rows")) * 100).alias("pct")
    )


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """V4: listwise deletion on ``cols`` (NaN counts as missing)."""
    return df.where(_complete_row(df, cols))


def _facts(df: DataFrame) -> DataFrame:
    r = roles(df)
    aggs = [F.count(F.lit(1)).alias("rows"), total_missing_expr(df).alias("missing")]
    if len(r.numeric) >= 2:
        aggs.append(F.count_if(_complete_row(df, r.numeric)).alias("complete_numeric"))
    else:
        aggs.append(F.lit(0).cast("bigint").alias("complete_numeric"))
    return df.agg(*aggs)


def _codes(*items: Column) -> Column:
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def _validation_struct(df: DataFrame, analysis_type: str) -> Column:
    """Validation of one type over the facts row (columns rows, missing, complete_numeric)."""
    r = roles(df)
    n_num, n_cat, n_cols = len(r.numeric), len(r.categorical), len(df.columns)
    rows, missing = F.col("rows"), F.col("missing")
    empty = rows == 0
    no_cols = F.lit(n_cols == 0)
    stop = empty | no_cols
    errors = [F.when(empty, F.lit("empty_dataset")), F.when(~empty & no_cols, F.lit("no_columns"))]
    warnings: list[Column] = []
    recs: list[Column] = []
    valid = ~stop
    if analysis_type == "correlation":
        if n_num < 2:
            errors.append(F.when(~stop, F.lit(f"too_few_numeric:{n_num}")))
            recs.append(F.when(~stop, F.lit(f"numeric_columns:{', '.join(r.numeric)}" if n_num else "no_numeric_columns")))
            valid = F.lit(False)
        else:
            warnings.append(F.when(~stop & (F.col("complete_numeric") < 5),
                                   F.concat(F.lit("few_complete_rows:"), F.col("complete_numeric").cast("string"))))
    elif analysis_type == "descriptive":
        if n_num == 0 and n_cat == 0:
            errors.append(F.when(~stop, F.lit("no_analysable_columns")))
            valid = F.lit(False)
        elif n_num == 0:
            warnings.append(F.when(~stop, F.lit("no_numeric_columns")))
        elif n_cat == 0:
            warnings.append(F.when(~stop, F.lit("no_categorical_columns")))
    warnings.append(F.when(~stop & (missing > rows * F.lit(n_cols) * F.lit(MISSING_LIMIT)),
                           F.concat(F.lit("many_missing_values:"), missing.cast("string"))))
    return F.struct(
        F.lit(analysis_type).alias("analysis_type"),
        (valid & ~stop).alias("is_valid"),
        _codes(*errors).alias("errors"),
        _codes(*warnings).alias("warnings"),
        _codes(*recs).alias("recommendations"),
    )


def validate(df: DataFrame, analysis_type: str) -> DataFrame:
    """One-row validation result of ``analysis_type`` (V5-V8 composed)."""
    return _facts(df).select(_validation_struct(df, analysis_type).alias("v")).select("v.*")


def check_not_empty(df: DataFrame) -> DataFrame:
    """V5: (is_valid, code)."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        ((F.col("rows") > 0) & F.lit(n_cols > 0)).alias("is_valid"),
        F.when(F.col("rows") == 0, F.lit("empty_dataset")).when(F.lit(n_cols == 0), F.lit("no_columns")).alias("code"),
    )


def check_correlation(df: DataFrame) -> DataFrame:
    """V6: correlation prerequisites."""
    return validate(df, "correlation").drop("analysis_type")


def check_descriptive(df: DataFrame) -> DataFrame:
    """V7: descriptive prerequisites."""
    return validate(df, "descriptive").drop("analysis_type", "recommendations")


def check_missing_ratio(df: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    """V8: (warn, ratio) -- warn when missing cells > limit x cells (strict)."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), total_missing_expr(df).alias("missing")).select(
        (F.col("missing") > F.col("rows") * F.lit(n_cols) * F.lit(limit)).alias("warn"),
        F.try_divide(F.col("missing"), F.col("rows") * F.lit(n_cols)).alias("ratio"),
    )


def compatibility_matrix(df: DataFrame, types: list[str] = ANALYSIS_TYPES) -> DataFrame:
    """V9: one validation row per analysis type, all from one aggregate."""
    return _facts(df).select(F.inline(F.array(*[_validation_struct(df, t) for t in types])))


def recommendations(df: DataFrame) -> DataFrame:
    """Ordered recommendation codes from the profile (missing % > 30, numeric count)."""
    n_num = len(roles(df).numeric)
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), total_missing_expr(df).alias("missing")).select(
        _codes(
            F.when(F.round(F.try_divide(F.col("missing"), F.col("rows") * F.lit(n_cols)) * 100, 2) > 30, F.lit("clean_missing")),
            F.lit("correlation" if n_num >= 2 else None),
            F.lit("descriptive" if n_num < 2 else None),
        ).alias("codes")
    )
