"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
all but the last return the columns of ``documents``. Between stages the documents are a
written table in the shared folder, so a lost executor never costs more than its stage.

SQL cannot express the trained classifier, the XXH64 fingerprints or the encoder, so there
is no ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds the stages against brute force.

Defined cases: those of the operators; a corpus that a stage empties stays empty to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.llm import linededup, mixing, queries, simhash, toxicity
from prism.llm.common import of, table
from prism.session import cut_lineage

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on their labels, doesn't reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occurred before; n_chars follows the text."""
    kept = linededup.dedup_lines(docs)
    length = F.length("text").cast("long").alias("n_chars")
    return kept.select(*[length if c == "n_chars" else of(kept, c) for c in kept.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the bytes they decode to."""
    return queries.token_digests(queries.tokens(docs), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
