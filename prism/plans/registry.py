"""Registry of named queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; write it as ``count(*) FILTER (...)``
    (BIGINT, as Spark's ``count_if``)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "(count(*) FILTER (WHERE " + _bigint_counts(sql[j + len(key):k - 1]) + "))")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _bigint_counts(sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canon(c, digits: int = 6):
    """Canonical rounding for cross-engine comparison: drop float noise at 9
    decimals, then round half-up exactly in decimal arithmetic."""
    if isinstance(c, str):
        c = F.col(c)
    return F.round(F.round(c.cast("double"), 9).cast("decimal(38,9)"), digits).cast("double")


def canon_sql(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`canon`."""
    return f"CAST(round(CAST(round(CAST({expr} AS DOUBLE), 9) AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Canonically round every floating column so results compare across engines."""
    return df.select(
        *[
            canon(f.name, digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
