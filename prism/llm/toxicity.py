"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of
the lexical features it holds (words and their prefixes, so that inflected forms of a
known stem count); the document's is the noisy-or of its sentences and a constant leak:
``1 - (1 - leak) * prod(1 - p)``. Only document labels are used: the likelihood of the
noisy-or is maximised over them, and the same sentence scores then locate the
offending sentences. Sentences without any chosen feature carry no evidence (p = 0),
so length alone never makes a document toxic.

Features are chosen and the weights fitted on at most ``SAMPLE`` labelled documents,
the first by a digest of doc_id; every document is scored.

Defined cases: null, empty and letterless texts score 0 + leak with no spans, as texts
without evidence do; null labels and ids are not learned from; without both kinds of
label the model is the leak alone, set to the share of toxic labels (0 if none);
repeated rows score alike; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled documents that the classifier is fitted on.
SAMPLE = 10_000
#: Most features kept, least toxic documents that hold one, least lower bound of its log odds ratio.
MAX_FEATURES, MIN_TOXIC, MIN_ODDS = 5_000, 5, 1.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
SPAN_P = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")
MEMO = 200_000


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    leak: float = 0.0


def word_features(word: str) -> list[str]:
    """The word itself and its prefixes (marked with a trailing ``~``)."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}
            (toxic if y else clean).update(seen)
    names = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_pydict({
        "feature": pa.array(names, pa.string()), "toxic": pa.array([toxic[n] for n in names], pa.int64()),
        "clean": pa.array([clean[n] for n in names], pa.int64())})


def _instances(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[sorted(hits) for _, _, hits in sentence_hits(t, vocabulary, {}) if hits]
                    for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "bag": pa.array(bags, pa.list_(pa.list_(pa.int32())))})

    return run


def sentence_hits(text: str, vocabulary: dict, memo: dict) -> Iterator[tuple[int, int, set]]:
    """(start, end, features of the vocabulary) of every sentence; nothing if the text holds none."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: keep the offsets
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    known: dict[str, tuple] = {}
    for word in set(WORDS.findall(lowered)):
        found = memo.get(word)
        if found is None:
            if len(memo) > MEMO:
                memo.clear()
            found = memo[word] = tuple(vocabulary[f] for f in word_features(word) if f in vocabulary)
        if found:
            known[word] = found
    if not known:
        return
    for m in SENTENCE.finditer(lowered):
        hits = {f for w in known.keys() & WORDS.findall(m[0]) for f in known[w]}
        yield m.start(), m.end(), hits


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 400) -> Model:
    """Learn from the labels of documents that are not held out (columns doc_id, text; doc_id, toxic)."""
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
            .select("text", "toxic"))
    by_label = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(leak=float(bool(n_toxic)))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 0.5 - F.col("toxic"))) - F.log(b / (n_clean + 0.5 - F.col("clean")))
    features = (rows.mapInArrow(_partial_counts, "feature string, toxic long, clean long")
                .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                .where(F.col("toxic") >= MIN_TOXIC).select("feature", (odds - 2 * F.sqrt(1 / a + 1 / b)).alias("least"))
                .where(F.col("least") > MIN_ODDS).orderBy(F.desc("least"), "feature").limit(MAX_FEATURES))
    names = sorted(r["feature"] for r in features.collect())
    vocabulary = {n: i for i, n in enumerate(names)}
    bags = rows.mapInArrow(_instances(vocabulary), "toxic int, bag array<array<int>>").collect()
    return _maximise(names, [(r["toxic"], r["bag"]) for r in sorted(bags, key=lambda r: (r["toxic"], r["bag"]))], rounds)


def _maximise(names: list[str], bags: list[tuple[int, list[list[int]]]], rounds: int) -> Model:
    """Adam ascent on the noisy-or likelihood with a small quadratic penalty."""
    y = np.array([t for t, _ in bags], float)
    sentence_bag = np.array([i for i, (_, bag) in enumerate(bags) for _ in bag], np.int64)
    entries = [(s, f) for s, hits in enumerate(h for _, bag in bags for h in bag) for f in hits]
    at, feature = (np.array(x, np.int64) for x in (zip(*entries) if entries else ((), ())))
    n, k, m = len(bags), len(names), len(sentence_bag)
    theta = np.concatenate([np.full(k, 1.0), [-2.0, -4.0]])  # weights, bias, logit of the leak
    mean, var = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, rounds + 1):
        w, bias, leak = theta[:k], theta[k], 1 / (1 + math.exp(-theta[k + 1]))
        logit = np.clip(bias + np.bincount(at, w[feature], minlength=m), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        none = np.bincount(sentence_bag, -np.logaddexp(0, logit), minlength=n) + math.log1p(-leak)
        none = np.minimum(none, -1e-12)
        ratio = np.where(y > 0, np.exp(none) / -np.expm1(none), -1.0)  # d log L / d(-log(1 - P))
        g_sentence = ratio[sentence_bag] * p
        grad = np.concatenate([np.bincount(feature, g_sentence[at], minlength=k) - 0.05 * w,
                               [g_sentence.sum() - 0.05 * bias, (ratio * leak).sum()]]) / n
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-9)
    return Model(dict(zip(names, theta[:k].tolist())), float(theta[k]), 1 / (1 + math.exp(-theta[k + 1])))


def score_text(text: str | None, model: Model, vocabulary: dict, memo: dict) -> tuple[float, list[dict]]:
    """The document's probability and the sentences with p >= SPAN_P as (start, end, p)."""
    none, spans = math.log1p(-min(model.leak, 1 - 1e-12)), []
    for start, end, hits in sentence_hits(text or "", vocabulary, memo):
        if hits:
            logit = max(-30.0, min(30.0, model.bias + sum(model.weights[f] for f in hits)))
            none -= math.log1p(math.exp(logit))
            if (p := 1 / (1 + math.exp(-logit))) >= SPAN_P:
                spans.append({"start": start, "end": end, "p": p})
    return -math.expm1(none), spans


def scorer(model: Model):
    """Arrow UDF: text -> struct(score, spans)."""
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])

    @F.arrow_udf("score double, spans array<struct<start: int, end: int, p: double>>")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, memo = {f: f for f in model.weights}, {}
        for texts in batches:
            out = [score_text(t.as_py(), model, vocabulary, memo) for t in texts]
            yield pa.array([{"score": s, "spans": spans} for s, spans in out], kind)

    return toxicity


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with."""
    return docs.where(scorer(fit(docs, labels))(F.col("text"))["score"] < threshold)
