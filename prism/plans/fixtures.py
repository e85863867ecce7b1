"""Stand-in inputs built from the driver tables, each with its SQL twin.

The tables carry no NULLs, so the same expression injects them on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.plans.registry import table

# Events / orders "now" stand-ins (fixed values of the fixtures).
EVENTS_ASOF = "2024-01-31 00:00:00"
ORDERS_ASOF = "2001-08-01 00:00:00"


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax"))).withColumn(
        "l_returnflag", F.when(F.col("l_linenumber") != 5, F.col("l_returnflag"))
    )


LINEITEM_NULLS_SQL = (
    "SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, "
    "CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag) FROM lineitem"
)


def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.withColumn("c_acctbal", F.when(~F.col("c_nationkey").isin(3, 7), F.col("c_acctbal"))).withColumn(
        "c_mktsegment", F.when(F.col("c_nationkey") != 11, F.col("c_mktsegment"))
    )


CUSTOMER_NULLS_SQL = (
    "SELECT * REPLACE (CASE WHEN c_nationkey NOT IN (3, 7) THEN c_acctbal END AS c_acctbal, "
    "CASE WHEN c_nationkey <> 11 THEN c_mktsegment END AS c_mktsegment) FROM customer"
)
