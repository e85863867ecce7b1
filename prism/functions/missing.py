"""Missing-value semantics: NULL and NaN are one concept (pandas ``isnull``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from prism.functions.sqltext import column


def is_float_type(dtype: DataType) -> bool:
    return isinstance(dtype, (DoubleType, FloatType))


def is_missing(name: str, dtype: DataType) -> Column:
    """True where the cell is missing: NULL, or NaN for floating columns."""
    c = column(name)
    if is_float_type(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean_numeric(name: str, dtype: DataType | None = None) -> Column:
    """Column as double with NaN turned into NULL, so aggregates skip it."""
    c = column(name).cast("double")
    return F.when(~F.isnan(c), c)
