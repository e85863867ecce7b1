"""Mixing sources to target weights by capped water-filling.

Sources (by code point, null last) get the weights 1, 2, 3, repeating, and share the
words of the whole corpus in that proportion; a target stops at ``max_epochs`` times
the words of its source and the excess is shared again by weight until none is above.

The fill has a closed form: with sources in the order of cap / weight, the water level
is ``(total - caps before) / (weights from here on)`` at the first source whose cap is
not below its share of that level. A document is then taken ``floor(target / words)``
times whole; what is left of the target is filled by the documents in the order of a
seeded digest, up to the one that comes nearest to it. The cut is found without
ordering a source: word sums by (source, first digits of the digest) show the one
bucket of a source in which the target is reached, and only its rows are ordered.

Defined cases: null text has size 0; a null source is a source of its own, last; rows
that repeat doc_id and text share a digest and are taken alike; no rows give no rows;
where all sizes are 0 every target is 0 and nothing is taken; other columns, whatever
their names, are kept by :func:`mix` and ignored by :func:`plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.llm.common import WORD, free_name, of
from prism.session import cut_lineage

SEED = 8
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hexadecimal digits of the digest that name a bucket: 4096 buckets of a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(seed: int) -> Column:
    """Seeded order of the documents, the same in every run."""
    blank = F.lit("")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), blank),
                             F.coalesce(F.col("text"), blank)))


def _targets(sums: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, words left to fill."""
    everything = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("_full_at"), F.col("source").asc_nulls_last())
    per = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("_weight"))
    per = per.withColumn("_cap", F.col("source_size") * float(max_epochs))
    per = per.withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    capped = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double")
    per = per.withColumn("_level", (total - capped) / left)
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_full_at"), F.col("_full_at"))).over(everything)
    per = per.withColumn("target", F.least("_cap", F.col("_weight") * F.coalesce(level, F.col("_full_at"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", F.least(epochs, F.lit(max_epochs)).cast("long"))
    return per.select("source", "source_size", "target", "whole",
                      (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def shares(facts: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, ``whole`` and ``cut``, the last digest that the
    partial repetition takes (null: none). ``facts`` has source, size and digest."""
    bucketed = facts.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = _targets(sums, weights, max_epochs)
    s, t, b = sums.alias("s"), targets.alias("t"), bucketed.alias("b")
    upto = Window.partitionBy("s.source").orderBy("s.bucket")
    reached = (s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
               .select("s.source", "s.bucket", "s.words", "t.rest", F.sum("s.words").over(upto).alias("upto"))
               .where("upto > rest and upto - words <= rest")
               .select("source", "bucket", "rest", (F.col("upto") - F.col("words")).alias("before")))
    r = reached.alias("r")
    near = (b.join(r, F.col("b.source").eqNullSafe(F.col("r.source")) & (F.col("b.bucket") == F.col("r.bucket")))
            .groupBy("r.source", "b.digest").agg(F.sum("b.size").alias("words"), F.first("r.rest").alias("rest"),
                                                 F.first("r.before").alias("before")))
    running = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("digest")) - F.col("words")
    inside = (near.withColumn("running", running).where(F.col("running") + F.col("words") / 2 <= F.col("rest"))
              .groupBy("source").agg(F.max("digest").alias("cut")))
    # a source whose crossing bucket gives nothing still takes the buckets before it
    edge = reached.select("source", F.col("bucket").alias("edge")).alias("e")
    i = inside.alias("i")
    per = (t.join(edge, F.col("t.source").eqNullSafe(F.col("e.source")), "left")
            .join(i, F.col("t.source").eqNullSafe(F.col("i.source")), "left")
            .select("t.source", "t.source_size", "t.target", "t.whole",
                    F.coalesce(F.col("i.cut"), F.col("e.edge")).alias("cut")))
    # written: the size of one row a source is then known, so few sources are broadcast and no hot one is shuffled to
    return cut_lineage(per, "mix-shares")


def _facts(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and digest, written once: one pass over the texts."""
    return cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   digest(seed).alias("digest")), "mix-facts")


def _repeats(key: Column, whole: Column, cut: Column, max_epochs: int) -> Column:
    return F.least(whole + F.when(key <= cut, 1).otherwise(0), F.lit(max_epochs)).cast("long")


def plan(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS,
         max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken for every document."""
    facts = _facts(docs, seed)
    f, s = facts.alias("f"), shares(facts, weights, max_epochs).alias("s")
    repeats = _repeats(F.col("f.digest"), F.col("s.whole"), F.col("s.cut"), max_epochs)
    return (f.join(s, F.col("f.source").eqNullSafe(F.col("s.source")))
            .select("f.doc_id", "f.source", "f.size", "s.source_size", "s.target", repeats.alias("repeats"))
            .withColumn("taken", F.col("repeats") * F.col("size")))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, with its columns."""
    s = shares(_facts(docs, seed), weights, max_epochs)
    s = s.toDF(*[free_name(docs, stem=f"mix_{c}") for c in s.columns])
    source, _, _, whole, cut = s.columns
    joined = docs.join(s, docs["source"].eqNullSafe(s[source]))
    repeats = _repeats(digest(seed), s[whole], s[cut], max_epochs).cast("int")
    nth = free_name(docs, stem="mix_nth")
    return (joined.where(repeats > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), repeats)))
            .select(*[of(docs, c) for c in docs.columns]))
