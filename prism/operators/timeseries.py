"""Time-series summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from prism.functions.dates import by_form, date_text, elected, forms_of, read_dates
from prism.functions.missing import clean_numeric
from prism.functions.scalar import fn_iso_timestamp
from prism.functions.sqltext import column


def _temporal(df: DataFrame, name: str):
    """Column ``name`` as timestamp where its type is temporal, else null."""
    t = df.schema[name].dataType
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return column(name)
    return column(name).cast("timestamp_ntz") if isinstance(t, DateType) else F.lit(None).cast("timestamp_ntz")


def timeseries_summary(df: DataFrame, date_column: str | None, value_column: str | None,
                       formats: list[str] | None = None) -> DataFrame:
    """(date_column, value_column, start, end, mean, std, min, max, n_observations, message).

    Rows missing a date or a value are dropped. Text dates have the first form that fits all values of the column
    (:mod:`prism.functions.dates`; ``formats`` in place of the known forms after ISO): one aggregate counts
    for every form how many values fit and keeps the first and last date it would give. If no form
    fits all, the message is ``date_parse_error:<values that do not fit the best form>`` and there are no
    statistics (the reference reports the parse exception). Missing parameters give the message
    ``missing_parameters``.
    """
    spark = df.sparkSession
    if not date_column or not value_column:
        return spark.range(1).select(
            F.lit(date_column).cast("string").alias("date_column"),
            F.lit(value_column).cast("string").alias("value_column"),
            *[F.lit(None).cast(t).alias(c) for c, t in [
                ("start", "string"), ("end", "string"), ("mean", "double"), ("std", "double"),
                ("min", "double"), ("max", "double"), ("n_observations", "bigint")]],
            F.lit("missing_parameters").alias("message"),
        )
    if isinstance(df.schema[date_column].dataType, StringType):
        work = df.select(date_text(date_column).alias("raw"), clean_numeric(value_column).alias("v"))
        work, readings = read_dates(work, ["raw"], formats)
        forms = [by_form(readings["raw"], f) for f in forms_of(formats)]
    else:
        work = df.select(column(date_column).alias("raw"), _temporal(df, date_column).alias("t"), clean_numeric(value_column).alias("v"))
        forms = ["t"]
    numbers = range(len(forms))
    there = "raw IS NOT NULL AND v IS NOT NULL"
    one = work.selectExpr(
        "count(raw) AS values",
        *[f"count({t}) AS fit{k}" for k, t in enumerate(forms)],
        *[f"min({t}) FILTER (WHERE {there}) AS from{k}" for k, t in enumerate(forms)],
        *[f"max({t}) FILTER (WHERE {there}) AS to{k}" for k, t in enumerate(forms)],
        *[f"{f}(v) FILTER (WHERE {there}) AS {n}" for n, f in
          (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("n", "count"))])
    fits = [f"fit{k}" for k in numbers]
    best = F.expr(f"greatest({', '.join(fits)})" if len(fits) > 1 else fits[0])
    good = best == F.col("values")
    return one.select(
        F.lit(date_column).alias("date_column"),
        F.lit(value_column).alias("value_column"),
        *[fn_iso_timestamp(F.expr(elected("values", fits, [f"{end}{k}" for k in numbers]))).alias(name)
          for end, name in (("from", "start"), ("to", "end"))],
        F.when(good, F.col("mean")).alias("mean"),
        F.when(good, F.col("std")).alias("std"),
        F.when(good, F.col("min")).alias("min"),
        F.when(good, F.col("max")).alias("max"),
        F.when(good, F.col("n")).alias("n_observations"),
        F.when(~good, F.concat(F.lit("date_parse_error:"), (F.col("values") - best).cast("string"))).alias("message"),
    )
