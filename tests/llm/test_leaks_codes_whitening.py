"""Decontamination, vector codes and whitening against brute force and on odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prism.llm import codes, decontaminate, queries, whiten
from tests.llm.helpers import LONG, documents

# --- benchmark decontamination ----------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_leak(text, items, limit=10):
    """(words, hit positions, item ids) by looking for every window at every place."""
    words, hit, found = words_of(text), set(), set()
    at = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for item, item_text in items:
        own = words_of(item_text)
        n = min(limit, len(own))
        for k in range(len(own) - n + 1) if n else ():
            window = own[k:k + n]
            for i in at.get(window[0], ()):
                if words[i:i + n] == window:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), hit, sorted(found)


def check_leaks(found, texts, items, limit=10):
    rows = found.collect()
    assert len(rows) == len(texts)
    for row in rows:
        n, hit, ids = slow_leak(row["text"], items, limit)
        spans = row["leak"]["spans"]
        assert row["leak"]["n_words"] == n and row["leak"]["items"] == ids
        assert {i for s in spans for i in range(s["first"], s["first"] + s["words"])} == hit
        assert sum(s["words"] for s in spans) == len(hit)
        for s in spans:
            assert words_of(row["text"][s["start"]:s["start"] + s["chars"]]) == words_of(row["text"])[s["first"]:s["first"] + s["words"]]


@pytest.mark.parametrize("parts", [None, 40])
def test_leaks_against_brute_force(spark, monkeypatch, parts):
    """With few words a part, several automata are built, items are cut into pieces and the scans are chained."""
    if parts:
        monkeypatch.setattr(decontaminate, "PART_WORDS", parts)
        monkeypatch.setattr(decontaminate, "PIECE", 14)
        monkeypatch.setattr(decontaminate, "CHAIN", 2)
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "É", "7"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 9, 10, 11, 30])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(words_of(t)) != 1] + [(50, items[3][1]), (50, items[4][1]), (50, items[4][1]), (None, "x y z w"), (51, None), (52, "...")]
    texts = [(i, "-".join(rng.choices(vocabulary + ["Z"], k=rng.choice([0, 1, 8, 40, 200])))) for i in range(30)]
    texts += [(100 + n, "Qq! " + t.upper() + " qq") for n, (_, t) in enumerate(items) if t] + [(None, None), (7, ""), (7, "\x00"), (8, "X  Y z.W x y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)))
    check_leaks(found, texts, items)


def test_leaks_of_odd_rows(spark):
    docs = documents(spark, clash=True).withColumn("leak", F.lit("own"))
    items = [(1, LONG), (2, "eleven twelve thirteen"), (3, "same line")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs, items_df)
    assert out.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (6, LONG) not in kept and all(i not in (7,) for i, _ in kept)  # hit as a whole
    assert (3, None) in kept and (4, "") in kept
    assert (1, "One two three four five six.\nSeven eight nine ten.\n.") in kept
    none = decontaminate.find(docs.drop("leak"), items_df.limit(0))
    assert none.where("size(leak.spans) > 0 or size(leak.items) > 0").count() == 0 and none.count() == 12
    assert decontaminate.find(docs.drop("leak").limit(0), items_df).count() == 0


def test_longest_matches(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([("zz " + " ".join(f"w{i}" for i in range(5, 30)) + " zz " + " ".join(f"w{i}" for i in range(9)),)], "text string")
    leak = decontaminate.find(docs, items).first()["leak"]
    assert [(s["first"], s["words"], s["longest"]) for s in leak["spans"]] == [(1, 25, 25)]


def test_op11_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op11_decontaminate(spark, sf_dir).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n, hit, ids = slow_leak(r["text"], items)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], n, len(hit), len(ids), digest, bool(hit))


# --- vector codes -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) of the kept rows in order, label sums and codebooks, with Python integers."""
    kept = [(i, [math.floor(256 * c) for c in v], l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cuts = [p * d // parts for p in range(parts + 1)]
    pieces = [[x[a:b] for _, x, _ in kept] for a, b in zip(cuts, cuts[1:])]
    books = [p[:entries] for p in pieces]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for x in pieces[p]:
                own.setdefault(nearest(x, book)[1], []).append(x)
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(book)]
    found = [[nearest(x, books[p]) for x in pieces[p]] for p in range(parts)]
    out = [(i, [f[n][1] for f in found], sum(f[n][0] for f in found), l) for n, (i, _, l) in enumerate(kept)]
    sums = {}
    for _, _, e, l in out:
        sums[l] = sums.get(l, 0) + e
    return sorted(((i, c, e, sums[l]) for i, c, e, l in out), key=str), books


def vector_rows(n=300, d=32, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i * 3 % 301, rng.normal(0, 0.2, d).tolist(), int(rng.integers(3))) for i in range(n)]
    return rows + [(i, [0.25] * d, None) for i in range(400, 460)] + [(2, rows[0][1], 1), (None, [-1.0] * d, None)]


@pytest.mark.parametrize("d", [32, 21, 5])
def test_codes_against_brute_force(spark, d):
    rows = vector_rows(d=d)
    df = spark.createDataFrame(rows + [(900, None, 1), (901, [math.nan] * d, 1), (902, [None] * d, 1), (903, [math.inf] * d, None)], VECTORS)
    df = df.select("*", *[F.lit(n).alias(n) for n in ("code", "error", "x", "near", "of")]).repartition(5)
    coded, books = codes.compress(df)
    expected, slow_books = slow_codes(rows)
    assert [b.tolist() for b in books] == slow_books
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()), key=str) == expected


def test_codes_of_odd_tables(spark):
    coded, books = codes.compress(spark.createDataFrame([], VECTORS))
    assert coded.count() == 0 and books == []
    odd = [(1, [0.5] * 16, 1), (2, [0.5] * 15, 1), (3, [], 1), (4, [1e300] + [0.0] * 15, 2), (5, [0.25] * 16, None)]
    rows = {r["vec_id"]: r for r in codes.compress(spark.createDataFrame(odd, VECTORS))[0].collect()}
    assert {i for i, r in rows.items() if r["code"] is None and r["error"] is None} == {2, 3, 4}
    assert rows[1]["error"] == rows[5]["error"] == 0 and rows[5]["label_error"] == 0
    alone = codes.decode(*codes.compress(spark.createDataFrame(odd[:1], VECTORS))).first()
    assert alone["decoded"] == [0.5] * 16


def test_pivots_only_order_and_prune():
    rng = np.random.default_rng(8)
    book, points = rng.integers(-90, 90, (64, 4)), rng.integers(-100, 100, (4000, 4))
    pivots = codes.pivots_of(book, 4)
    index, best, evaluated = codes.nearest(points, codes.squared(points, pivots), book, pivots)
    d = codes.squared(points, book)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert evaluated < d.size // 3
    ties = np.zeros((5, 4), np.int64)
    same = np.ones((7, 4), np.int64)
    assert codes.nearest(ties, codes.squared(ties, same[:1]), same, same[:1])[0].tolist() == [0] * 5
    assert len(codes.pivots_of(same, 4)) == 1


# --- whitening ----------------------------------------------------------------------------

def slow_whiten(rows, components=16):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(0)
    centred = np.array([[float(n * c - t) / n for c, t in zip(v, s)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-20).sum()))
    out = {}
    for i, v in x.items():
        row = np.array([float(n * c - t) / n for c, t in zip(v, s)])
        out[i] = (sum((n * c - t) ** 2 for c, t in zip(v, s)), row @ vectors[:, :k] / np.sqrt(values[:k]))
    return n, values[:k] / values.sum(), out


def test_whitening_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, explained, expected = slow_whiten(rows)
    got = {}
    for r in queries.op13_whitening(spark, sf_dir).collect():
        got[r["vec_id"], r["component"]] = r
    assert len(got) == len(rows) * 16
    whitened = np.array([[got[i, k]["whitened"] for k in range(1, 17)] for i, _ in rows])
    brute = np.array([expected[i][1] for i, _ in rows])
    signs = np.sign((whitened * brute).sum(0))
    assert np.abs(whitened * signs - brute).max() < 1e-8
    for (i, k), r in got.items():
        assert r["n"] == n and r["deviation"] == expected[i][0] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 2, 3).tolist()) for i in range(40)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    odd = [(200, None), (201, [math.nan] * 3), (202, [None] * 3), (203, [1.0] * 4), (204, []), (205, [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit(n).alias(n) for n in ("x", "v", "component", "label")])
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    n, _, expected = slow_whiten(rows)
    assert len(got) == 3 * (len(rows) + 3) and {r["vec_id"] for r in got if r["whitened"] is None} == {203, 204, 205}
    for r in got:
        if r["whitened"] is not None:
            assert r["n"] == n == 41 and r["deviation"] == expected[r["vec_id"]][0]
            assert abs(r["whitened"]) == pytest.approx(abs(expected[r["vec_id"]][1][r["component"] - 1]), abs=1e-9)
    points = whiten.prepared(df.where("vec_id >= 100 and vec_id < 130"))
    assert whiten.fit(points)[0].values == []  # one distinct vector has no spread
    assert whiten.fit(whiten.prepared(df.limit(0)))[0] is None


@pytest.mark.parametrize("name, spectrum", [
    ("graded", np.logspace(0, -12, 40)), ("equal", np.ones(40)), ("clusters", np.repeat([3.0, 2.0, 1.0], [10, 10, 20])),
    ("close", 1 + 1e-9 * np.arange(40)), ("pair", np.array([1, 1 + 1e-13, *[0.5] * 38])), ("rank", np.array([*np.arange(1.0, 6), *np.zeros(35)])),
])
def test_solver(name, spectrum):
    rng = np.random.default_rng(4)
    u, w = np.linalg.qr(rng.standard_normal((300, 40)))[0], np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = u * spectrum @ w.T
    directions, values, trace = whiten.solve(np.linalg.qr(a, mode="r"), 1, 16)
    expected = np.sort(spectrum**2)[::-1][:len(values)]
    assert len(values) == min(16, int((spectrum > 0).sum()))
    assert np.allclose(values, expected, rtol=1e-11 if name != "graded" else 1e-3) and trace == pytest.approx((spectrum**2).sum())
    assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-11
    assert np.abs(a.T @ (a @ directions) - directions * values).max() < 1e-13 * expected[0] * 40


def test_whitening_tree_merges(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 9, (500, 6)))], "vec_id long, embedding array<double>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        model, distinct = whiten.fit(whiten.prepared(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert distinct.rdd.getNumPartitions() > 2 and model.directions.shape == (6, 6)
    assert whiten.identity_error(model, distinct) < 1e-12
