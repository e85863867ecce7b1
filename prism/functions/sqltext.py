"""Small helpers for building Spark SQL expression text.

Wide aggregates (hundreds of expressions over many columns) are built as SQL
text with ``F.expr``: one parser call per expression instead of one gateway
round trip per expression node, which keeps plan construction cheap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Backtick-quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def slit(text: str) -> str:
    """String literal of SQL text (also with quotes and backslashes in it)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    """The column of that very name, also where it holds dots, quotes or spaces."""
    return F.col(q(name))


def dlit(x: float) -> str:
    """Exact double literal (shortest round-trip repr)."""
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({x!r}D)"


def clean_double(name: str) -> str:
    """Column as double with NaN -> NULL."""
    c = f"CAST({q(name)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"
