"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters that are neither a space nor one of U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The letters that count as upper and lower case where only A-Z is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, *others: DataFrame, stem: str) -> str:
    """A column name that none of the frames has (names compare without case)."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def of(df: DataFrame, name: str) -> Column:
    """The frame's own column of that very name."""
    return df["`" + name.replace("`", "``") + "`"]


def col(name: str) -> Column:
    """The top-level column of that very name, also where the name has dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")
