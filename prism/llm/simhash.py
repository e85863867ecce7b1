"""SimHash near-dedup by anchor-point covering.

Fingerprints: 64 bits, bit set if it is set in over half the XXH64 values of a text's
word shingles, repeats included. Fingerprints link at ``max_bits`` or fewer differing bits.

The 64 bits fall into three segments of 21, 21 and 22 bits. Two fingerprints that differ
in at most 4 bits differ in at most 1 bit in one segment. In each segment the anchors are
the words of a covering code: a Hamming [15, 11] code on the first 15 bits, any value on
the rest. Its covering radius is 1, so each segment value has a home anchor at distance 1
or less, and whatever is within 1 bit of it lies within radius + 1 = 2 of that anchor.
Each distinct fingerprint is sent to its home and to every anchor within 2 bits (about 15
a segment); at an anchor the fingerprints at home there are compared with all that came.
So every link is found, whatever the data. An anchor's task writes a spanning forest of its links, never
all pairs; an anchor with more than ``BLOCK`` fingerprints is dealt to several tasks, each
with all fingerprints at home there and a share of the rest.

Copies meet as one fingerprint before all this, so a group of copies costs one row.

Defined cases: null and empty texts and texts without a word have fingerprint 0, linked
like any other; fewer words than a shingle are one shingle; null ids take part and
component_id ignores them (null if the component has no other); repeated rows stay; no
rows give no rows; other columns are kept by :func:`keep_one`, ignored by :func:`groups`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prism.llm.common import col, free_name
from prism.llm.components import connected_components
from prism.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fixed values: (first bit, width) of the segments; length of the Hamming code in each.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE = 15
#: Fingerprints at an anchor that one task compares; more are dealt to several tasks.
BLOCK = 200_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *ends]
        hashes = [xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[k - 1:])]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):  # bounded memory for very long texts
        part = np.array(hashes[i:i + 8192], np.uint64)
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def fingerprint_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(t.as_py()) for t in batch], pa.int64())


def _syndrome(value: int) -> int:
    """Syndrome of the first 15 bits: bit i (from 0) has the parity-check column i + 1."""
    s = 0
    for i in range(CODE):
        if value >> i & 1:
            s ^= i + 1
    return s


def anchor_masks(width: int, radius: int) -> list[list[int]]:
    """By syndrome: the differences of at most ``radius`` bits that lead to an anchor, the home first."""
    masks: list[list[int]] = [[] for _ in range(CODE + 1)]
    for weight in range(radius + 1):
        for bits in combinations(range(width), weight):
            mask = sum(1 << b for b in bits)
            masks[_syndrome(mask)].append(mask)
    return masks


def _replicas(fp: Column) -> Column:
    """Array of (anchor with its segment, home?) of a fingerprint."""
    def segment(number: int, first: int, width: int) -> Column:
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        syndrome = F.lit(0)
        for i in range(CODE):
            syndrome = syndrome.bitwiseXOR(F.when(value.bitwiseAND(F.lit(1 << i)) != 0, F.lit(i + 1)).otherwise(F.lit(0)))
        table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in anchor_masks(width, 2)])
        return F.transform(F.get(table, syndrome), lambda m, i: F.struct(
            (value.bitwiseXOR(m) + F.lit(number << 32)).alias("anchor"), (i == 0).alias("home")))

    return F.concat(*[segment(n, first, width) for n, (first, width) in enumerate(SEGMENTS)])


def _forest(fps: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join what the home fingerprints' links join, at most one for each fingerprint."""
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    joined = False
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= max_bits)
        if len(near) > 1:
            old = np.unique(label[near])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
                joined = True
    if not joined:
        return []
    return [(int(fps[i]), int(fps[label[i]])) for i in np.flatnonzero(label != np.arange(len(fps)))]


def _compare(max_bits: int):
    """Partitions sorted by (anchor, part) -> edges; one anchor is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []

        def edges(last: bool) -> pa.RecordBatch:
            key, fp, home = (np.concatenate(x) for x in zip(*rest))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([len(key)] if last else [])]
            homes = np.concatenate([[0], np.cumsum(home)])
            found = []
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1 and homes[b] > homes[a]:
                    found += _forest(fp[a:b], home[a:b], max_bits)
            rest[:] = [] if last else [(key[bounds[-1]:], fp[bounds[-1]:], home[bounds[-1]:])]
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            rest.append((key, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)))
            if (rest[0][0][0] != key[-1]).any():  # at least one anchor is complete
                yield edges(False)
        if rest:
            yield edges(True)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that join all fingerprints within ``max_bits``."""
    if not 0 <= max_bits <= 5:
        raise ValueError("three segments with one differing bit in one of them cover at most 5 bits")
    sent = fps.select("fp", F.explode(_replicas(F.col("fp"))).alias("r")).select("fp", "r.anchor", "r.home")
    crowded = (sent.groupBy("anchor").count().where(F.col("count") > BLOCK)
               .select("anchor", F.ceil(F.col("count") / BLOCK).cast("long").alias("parts")))
    dealt = sent.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    part = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = dealt.select("anchor", F.explode(part).alias("part"), "fp", "home")
    return (dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"), "fp")
            .mapInArrow(_compare(max_bits), "a long, b long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp of every document, written once: one pass over the texts."""
    return cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                                   fingerprint_udf(F.col("text")).alias("fp")), "simhash")


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp -> component (its smallest fingerprint) and component_id, for every distinct fingerprint."""
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    components = connected_components(links(prints.select("fp").distinct(), max_bits))
    s, c = smallest.alias("s"), components.alias("c")
    of = s.join(c, F.col("s.fp") == F.col("c.node"), "left").select(
        "s.fp", "s.doc_id", F.coalesce("c.component", "s.fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of.join(ids, "component").select("fp", "component", "component_id")


def components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    prints = fingerprints(docs)
    return prints.join(groups(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, that with the smallest doc_id (of rows that share it,
    the one with the smallest text hash; of rows that repeat both, one)."""
    prints = fingerprints(docs)
    best = prints.join(groups(prints, max_bits), "fp").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                       "text_hash")).alias("best"))
    names = [free_name(docs, stem=f"keep_{c}") for c in ("no_id", "id", "text_hash", "nth")]
    keep = best.select(*[F.col(f"best.{c}").alias(n) for c, n in zip(("no_id", "id", "text_hash"), names)])
    own = (docs["doc_id"].isNull(), F.coalesce(docs["doc_id"], F.lit(0)), F.xxhash64(docs["text"]))
    found = docs.select("*", *[c.alias(n) for c, n in zip(own, names)]).join(keep, names[:3])
    same_row = Window.partitionBy(*names[:3]).orderBy(names[2])
    return found.withColumn(names[3], F.row_number().over(same_row)).where(col(names[3]) == 1).select(
        *[col(c) for c in docs.columns])
