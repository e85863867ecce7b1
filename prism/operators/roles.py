"""Column roles and schema/preview operators.

Roles follow the pandas selection rules of the reference: numeric is any
integral/fractional/decimal type (bool excluded), categorical is text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
    CharType,
)

from prism.functions.dates import date_text, forms_of, read_dates
from prism.functions.missing import is_missing
from prism.functions.sqltext import column, q, slit

# Fixed byte widths of the logical size estimate (P7): width of one value by Spark type name.
FIXED_WIDTHS = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def role_of(dtype, dates_as_categorical: bool = False) -> str:
    if isinstance(dtype, BooleanType):
        return "boolean"
    if isinstance(dtype, (NumericType, DecimalType)):
        return "numeric"
    if isinstance(dtype, (StringType, VarcharType, CharType)):
        return "categorical"
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return "categorical" if dates_as_categorical else "temporal"
    return "other"


@dataclass
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    temporal: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)


def roles(df: DataFrame, dates_as_categorical: bool = False) -> Roles:
    r = Roles()
    for f in df.schema.fields:
        getattr(r, role_of(f.dataType, dates_as_categorical)).append(f.name)
    return r


def _long(rows: list[Column]) -> Column:
    """Array of structs to rows: the unpivot used for one-row aggregates."""
    return F.inline(F.array(*rows))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(pos, column_name, dtype, role, missing, distinct).

    Missing cells of all columns are one aggregate. Distinct counts exclude missing values
    (NaN included), as pandas ``nunique``; see :func:`prism.operators.describe.distinct_counts`.
    ``approx=True`` uses HyperLogLog++ sketches in the same single pass.
    """
    from prism.operators.describe import distinct_counts

    fields = df.schema.fields
    aggs = [F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]
    if approx:
        aggs += [F.approx_count_distinct(F.when(~is_missing(f.name, f.dataType), column(f.name))).alias(f"d{i}")
                 for i, f in enumerate(fields)]
    rows = df.agg(*aggs).select(_long([
        F.struct(
            F.lit(i + 1).alias("pos"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(role_of(f.dataType)).alias("role"),
            F.col(f"m{i}").alias("missing"),
            *([F.col(f"d{i}").alias("distinct")] if approx else []),
        )
        for i, f in enumerate(fields)
    ]))
    if approx:
        return rows
    return (rows.join(distinct_counts(df).withColumnRenamed("n", "distinct"), "column_name")
            .select("pos", "column_name", "dtype", "role", "missing", "distinct"))


def numeric_projection(df: DataFrame) -> DataFrame:
    """Only the numeric columns."""
    return df.select(*map(q, roles(df).numeric))


def date_candidates(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """(column_name, is_date, form) for every text column: the first of the date forms (or of ISO and
    ``formats``) that fits all its values, see :mod:`prism.functions.dates`. One aggregate over all
    rows and columns; a column without values is no date."""
    names, forms = roles(df).categorical, forms_of(formats)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, is_date boolean, form string")
    texts = {n: f"c{i}" for i, n in enumerate(names)}
    read, readings = read_dates(df.select(*[date_text(n).alias(t) for n, t in texts.items()]), list(texts.values()), formats)
    # one row for each value and reading, counted before it is shuffled: at most columns x forms rows a task
    each = read.selectExpr("inline(array(" + ", ".join(
        f"struct({i} AS pos, {t} IS NOT NULL AND {k} = 0 AS value, {f} AS form, {time} IS NOT NULL AS fits)"
        for i, t in enumerate(texts.values()) for k, (f, time) in enumerate(readings[t])) + "))")
    order = "array_position(array(" + ", ".join(map(slit, forms)) + "), form)"
    counts = (each.groupBy("pos", "form").agg(F.count_if("value").alias("n"), F.count_if("fits").alias("fits"))
              .groupBy("pos").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.expr(order).alias("place"), "form", "fits")).alias("forms")))
    whole = F.array_min(F.filter("forms", lambda f: f["form"].isNotNull() & (f["fits"] == F.col("n")) & (F.col("n") > 0)))["form"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    return counts.select(name.alias("column_name"), whole.isNotNull().alias("is_date"), whole.alias("form"))


def preview_head(df: DataFrame, key: list[str] | str, n: int = 10) -> DataFrame:
    """First ``n`` rows by a total order (file order is not defined in Spark)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """P5: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def dtype_histogram(df: DataFrame) -> DataFrame:
    """(dtype, n, n_empty): columns per dtype, and how many of them hold no value; one aggregate."""
    fields = df.schema.fields
    one = df.agg(*[F.count_if(~is_missing(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = one.select(_long([F.struct(F.lit(f.dataType.simpleString()).alias("dtype"), (F.col(f"n{i}") == 0).alias("empty"))
                             for i, f in enumerate(fields)]))
    return rows.groupBy("dtype").agg(F.count(F.lit(1)).alias("n"), F.count_if("empty").alias("n_empty"))


def size_expr(df: DataFrame) -> Column:
    """Aggregate expression of the logical byte size."""
    parts = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in FIXED_WIDTHS:
            parts.append(F.count(column(f.name)) * F.lit(FIXED_WIDTHS[t]))
        elif isinstance(f.dataType, (StringType, VarcharType, CharType)):
            parts.append(F.coalesce(F.sum(F.octet_length(column(f.name))), F.lit(0)))
        elif isinstance(f.dataType, DecimalType):
            parts.append(F.count(column(f.name)) * F.lit(16))
        else:
            parts.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(column(f.name))))), F.lit(0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def size_estimate(df: DataFrame) -> DataFrame:
    """Logical bytes = fixed width x non-null cells + UTF-8 bytes of text cells."""
    return df.agg(size_expr(df).alias("bytes")).select(
        "bytes", F.round(F.col("bytes") / F.lit(1024 * 1024), 6).alias("mb")
    )


def dataset_card(df: DataFrame, name: str) -> DataFrame:
    """One-row card (name, rows, columns, columns per role and per dtype, missing cells, bytes)."""
    r = roles(df)
    miss = [F.count_if(is_missing(f.name, f.dataType)) for f in df.schema.fields]
    total_missing = miss[0]
    for m in miss[1:]:
        total_missing = total_missing + m
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        total_missing.cast("bigint").alias("missing_cells"),
        size_expr(df).alias("bytes"),
    ).select(
        F.lit(name).alias("name"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(r.numeric)).cast("bigint").alias("numeric_columns"),
        F.lit(len(r.categorical)).cast("bigint").alias("categorical_columns"),
        F.lit(len(r.boolean)).cast("bigint").alias("boolean_columns"),
        F.lit(", ".join(f"{t}: {k}" for t, k in sorted(Counter(f.dataType.simpleString() for f in df.schema.fields).items())))
        .alias("dtypes"),
        "missing_cells",
        "bytes",
    )
