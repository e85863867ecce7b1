"""SimHash, line dedup, mixing, BPE, licences, quality and toxicity against brute force and on odd input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from prism.llm import bpe, components, licenses, linededup, mixing, perplexity, queries, simhash, toxicity
from tests.llm.helpers import CLASHING, ROWS, documents

SPACE = "\x20\x09-\x0d"


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- SimHash ---------------------------------------------------------------

def slow_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(prints):
    """prints: list of (doc_id, fingerprint) -> smallest doc_id by fingerprint."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    least = {}
    for doc, f in prints:
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return {f: least.get(find(f)) for f in fps}


def test_simhash_against_brute_force(spark, sf_dir):
    found = queries.QUERIES["op4_simhash"](spark, sf_dir).collect()
    own = texts(spark, sf_dir)
    prints = [(d, slow_fingerprint(t)) for d, t in own.items()]
    component = slow_components(prints)
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found} == {(d, f, component[f]) for d, f in prints}


def test_anchors_cover_every_pair_within_the_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for flips in (1, 2, 3, 4, 5, 6):
            g = f
            for b in rng.choice(64, flips, replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    by = {}
    for f, s in zip(fps, signed):
        by.setdefault(found.get(s, s), set()).add(f)
    expected = slow_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = {}
    for f, c in expected.items():
        groups.setdefault(c, set()).add(f)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups.values()))


def test_simhash_splits_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    near = [0b11 << i for i in range(40)] + [1 << i for i in range(60)] + list(range(1 << 20, (1 << 20) + 200))
    fps = spark.createDataFrame([(f,) for f in sorted(set(near))], "fp long")
    found = {r.node: r.component for r in components.connected_components(simhash.links(fps)).collect()}
    expected = slow_components([(f, f) for f in set(near)])
    assert found == {f: c for f, c in expected.items() if list(expected.values()).count(c) > 1}


def test_simhash_odd_rows(spark):
    found = simhash.components(documents(spark, clash=True)).collect()
    assert len(found) == len(ROWS)
    expected = slow_components([(r[0], slow_fingerprint(r[1])) for r in ROWS])
    for r in found:
        assert r.component_id == expected[r.fp % 2**64]
    kept = simhash.keep_one(documents(spark, clash=True))
    assert kept.columns == documents(spark, clash=True).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for c in expected.values()})
    assert simhash.keep_one(documents(spark, [])).count() == 0
    assert simhash.components(documents(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(70)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(71)}, 100: 100, **{200 + i: 100 for i in range(50)}}


# --- line dedup ------------------------------------------------------------

def slow_pieces(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * linededup.BASE + h[i]) % linededup.MODULUS for i in range(len(h))]
    ends = [i for i in range(1, len(r) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]] + [len(r) - 1]
    start, out = 0, []
    for e in ends:
        out += [(s, min(linededup.MAX_LINES, e - s + 1)) for s in range(start, e + 1, linededup.MAX_LINES)]
        start = e + 1
    return out


def slow_dedup(rows):
    """Rows (doc_id, text) -> the text each comes out with."""
    seen, out = {}, {}
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n")
        kept = []
        for place, (s, n) in enumerate(slow_pieces(lines)):
            chunk = "\n".join(lines[s:s + n])
            if n < 2 or seen.setdefault(chunk, (doc, text, place)) == (doc, text, place):
                kept.append(chunk)
        out[doc, text] = "\n".join(kept)
    return out


def test_line_dedup_odd_rows(spark):
    docs = documents(spark, clash=True)
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    expected = slow_dedup([(r[0], r[1]) for r in ROWS])
    got = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    assert got == Counter((r[0], expected.get((r[0], r[1]))) for r in ROWS)
    assert out.where("digest <> 'own digest'").count() == 0
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_long_passage_is_found_behind_other_lines(spark):
    passage = "\n".join(f"passage line {i} " + "with words " * 8 for i in range(12))
    rows = [(i, "\n".join([*(f"doc {i} line {j}" for j in range(i)), passage, f"doc {i} ends"]), "en", "a", 0) for i in range(2, 8)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert out == {d: slow_dedup([r[:2] for r in rows])[d, t] for d, t, *_ in rows}
    inside = [sum(f"passage line {i} " in t for i in range(12)) for d, t in sorted(out.items())]
    assert inside[0] == 12 and max(inside[1:]) <= 8
    assert all(f"doc {d} line 0" in t for d, t in out.items())


# --- mixing ----------------------------------------------------------------

def slow_targets(sizes):
    """Water-filling round by round: source -> words to source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    left = total
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("rows", [ROWS, [(i, "w " * (i % 7 + 1), "en", "abc"[i % 50 // 24], 0) for i in range(900)]])
def test_mixing_targets_and_takes(spark, rows):
    plan = mixing.plan(documents(spark, rows, clash=True)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = slow_targets({s: sizes[s] for s in {r[3] for r in rows}})
    taken, largest = Counter(), Counter()
    assert len(plan) == len(rows)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    per_row = Counter((r[0], r[1]) for r in rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] * max(per_row.values())
    assert sorted(map(str, mixing.plan(documents(spark, rows)).collect())) == sorted(map(str, plan))


def test_mix_repeats_rows(spark):
    docs = documents(spark, clash=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.repeats
    assert Counter(r.doc_id for r in mixed.collect()) == +plan
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.plan(documents(spark, [])).count() == 0


# --- byte-level BPE ----------------------------------------------------------

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check_tokens(spark, rows, **options):
    encoded = bpe.encode(documents(spark, rows, clash=True), RANKS, public_tokenizers.PATTERN, **options)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(spark, encoded, RANKS).collect())
    expected = Counter((r[0], tuple(TIKTOKEN.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert got == expected
    both = bpe.encode(documents(spark, rows), RANKS, public_tokenizers.PATTERN, decoded=True, **options)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect()) == expected


def test_bpe_odd_rows_and_small_blocks(spark):
    check_tokens(spark, ROWS)
    check_tokens(spark, ROWS, block_chars=100)
    check_tokens(spark, [])


def test_bpe_query_matches_tiktoken(spark, sf_dir):
    own = texts(spark, sf_dir)
    for r in queries.QUERIES["op6_byte_bpe"](spark, sf_dir).collect():
        ids = TIKTOKEN.encode_ordinary(own[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=40), st.text("abcdeé ", min_size=65, max_size=300).map(str.encode)))
def test_words_encode_as_tiktoken(word):
    assert bpe.encode_word(word, RANKS) == TIKTOKEN._encode_single_piece(word)


@pytest.mark.parametrize("positions", [[], [0], [127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1, 5]])
def test_positions_pack_and_unpack(positions):
    assert bpe._unpack(bpe._pack(np.array(positions, np.uint32))).tolist() == positions


# --- licences ----------------------------------------------------------------

def slow_scan(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()]
            for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_against_brute_force(spark, sf_dir):
    own = texts(spark, sf_dir)
    found = queries.QUERIES["op7_license_scan"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found} == {
        d: slow_scan(t) for d, t in own.items()}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize("text", [*[r[1] for r in ROWS], "MIT License mit LICENSE\nmit-license", "apache License, general PUBLIC license é mit"])
def test_license_base_odd_texts(text):
    scan = licenses.scan_text(text or "", licenses.automaton())
    base = [m for m in scan["matches"] if m["kind"] == "base"]
    at = [m["first"] for m in base]
    assert (scan["n_words"], len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted({m["label"] for m in base}))) == slow_scan(text)


@pytest.mark.parametrize("line, expression, families, permissive", [
    ("MIT", "MIT", ["mit"], True),
    ("MIT OR GPL-2.0-only AND Apache-2.0", "MIT OR GPL-2.0-only AND Apache-2.0", ["apache", "gpl", "mit"], True),
    ("(MIT or GPL-2.0-only) and MPL-2.0 */", "(MIT or GPL-2.0-only) and MPL-2.0", ["gpl", "mit", "mpl"], False),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause", "GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause", ["bsd", "gpl"], True),
    ("Apache-2.0 and then some", "Apache-2.0 and then", ["apache", "other"], False),
    ("(MIT", None, None, None),
    ("AND MIT", None, None, None),
    ("", None, None, None),
    ("MIT)", "MIT", ["mit"], True),
])
def test_license_expressions(line, expression, families, permissive):
    found = licenses.scan_text(f"// SPDX-License-Identifier: {line}\nmore", licenses.automaton())["expressions"]
    assert found == ([] if expression is None else [{"expression": expression, "families": families, "permissive": permissive}])


def test_license_scan_odd_rows(spark):
    docs = documents(spark, clash=True)
    found = docs.select("doc_id", licenses.scanner()(F.col("text")).alias("s"))
    assert found.select("doc_id", licenses.labels(F.col("s")), licenses.score(F.col("s"))).count() == len(ROWS)
    assert documents(spark, []).select(licenses.scanner()(F.col("text")).alias("s")).count() == 0


# --- quality -----------------------------------------------------------------

def slow_base(text):
    w, windows = words(text), {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "# c", "d\n"]), max_size=60).map(" ".join))
def test_base_counts(text):
    assert perplexity.base_counts(text) == slow_base(text)


def test_base_counts_odd_texts():
    for _, text, *_ in ROWS:
        assert perplexity.base_counts(text or "") == slow_base(text)


def test_blocks_are_shuffled_packed():
    texts = [f"the {i} sheep went over the hill number {i * i} and came back\n" * (i % 5) for i in range(500)] + [None, "", "\U0001f411"]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "key": pa.array([f"={i % 2}" for i in range(len(texts))]),
                                       "text": pa.array(texts, pa.string()), "block": pa.array([i % 3 for i in range(len(texts))], pa.int32())})
    packs = pa.Table.from_batches(perplexity._packed(iter([rows.slice(0, 200), rows.slice(200)])))
    assert sorted(packs["block"].to_pylist()) == [0, 1, 2] and packs.nbytes < rows.nbytes / 3
    for block in range(3):
        mine = packs.filter(pc.equal(packs["block"], block))
        assert perplexity._unpacked(mine).to_pylist() == [{k: r[k] for k in ("doc_id", "key", "text")} for r in rows.to_pylist() if r["block"] == block]
        grams = Counter((r["key"], r["context"], r["last"]) for r in perplexity._block_grams(mine).to_pylist())
        expected = {(f"={i % 2}", context, last) for i in range(block, len(texts), 3) if texts[i]
                    for found in perplexity.grams(*perplexity.symbols([texts[i]])) for context, last in zip(*(x.tolist() for x in found[:2]))}
        assert grams == Counter(expected)


def slow_kneser_ney(texts):
    """Probability function of a modified Kneser-Ney 4-gram model, from dictionaries."""
    classes = perplexity.character_classes()
    counts = {4: Counter()}
    for t in texts:
        c = (0, 0, 0, *(int(classes[ord(x)]) for x in t))
        counts[4].update(c[i:i + 4] for i in range(len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: perplexity._discounts(np.array(list(c.values()))) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / perplexity.CLASSES
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        c = own.get(gram, 0)
        return (c - d[n][min(c, 3)]) / total + sum(d[n][min(x, 3)] for x in own.values()) / total * p(gram[1:])

    return p


def test_kneser_ney_against_brute_force(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(["the cat sat on the mat", "the dog. the 2 dogs #", "a cat", "zz top"])]
    model = perplexity.model_of(documents(spark, rows))["en"]
    p = slow_kneser_ney([r[1] for r in rows])
    grams = [(0, 0, 0, 20), (20, 8, 5, 29), (8, 5, 29, 3), (5, 29, 3, 9), (1, 1, 1, 1), (29, 29, 29, 29), (20, 8, 9, 31)]
    code = np.array([((a * 32 + b) * 32 + c) * 32 + d for a, b, c, d in grams])
    assert np.exp(perplexity.log_probabilities(model, code)) == pytest.approx([p(g) for g in grams], rel=1e-5)
    for context in ((0, 0, 0), (20, 8, 5), (8, 5, 29)):
        assert sum(p((*context, c)) for c in range(32)) == pytest.approx(1)
    own = np.array([((0 * 32 + 0) * 32 + 0) * 32 + c for c in range(32)])
    assert np.exp(perplexity.log_probabilities(model, own)).sum() == pytest.approx(1, rel=1e-4)


def slow_code_points(texts):
    """Probability function of a modified Kneser-Ney model of 4-grams of code points, from dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        c = (0, 0, 0, *(ord(x) + 1 for x in t))
        counts[4].update(c[i:i + 4] for i in range(len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: perplexity._discounts(np.array(list(c.values()))) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        own = [c for g, c in counts[n].items() if g[:-1] == gram[:-1]]
        c = counts[n][gram]
        return (c - d[n][min(c, 3)]) / sum(own) + sum(d[n][min(x, 3)] for x in own) / sum(own) * p(gram[1:])

    return {g: p(g) for g in counts[4]}


def test_code_point_model_against_brute_force(spark, monkeypatch):
    texts = {"en": ["the cat sat on the mat", "the dog. \x00the 2 dogs #", "a cat", "zz top"], "ru": ["кот и мат и кот", "\U0001f600 кит"], "": ["the"], None: ["она"]}
    docs = spark.createDataFrame([(k, t) for k, v in texts.items() for t in [*v, None, ""]], "key string, text string").fillna("none", ["key"])
    got = {}
    for r in perplexity.probabilities(docs).collect():
        symbols = [(r.context >> (21 * k)) & (2**21 - 1) for k in (2, 1, 0)]
        got[r.key, (*symbols, r.last)] = r.p
    expected = {(k or ("none" if k is None else k), g): p for k, v in texts.items() for g, p in slow_code_points(v).items()}
    expected |= {(perplexity.ALL, g): p for g, p in slow_code_points([t for v in texts.values() for t in v]).items()}
    assert got == pytest.approx(expected, rel=1e-9)


def test_grams_of_many_symbols_are_whole():
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 20_000))) + "".join(map(chr, range(0x20000, 0x20000 + 40_000))), "ab", "abab"]
    found = Counter()
    for context, last, n in perplexity.grams(*perplexity.symbols(texts)):
        for c, x, k in zip(context.tolist(), last.tolist(), n.tolist()):
            found[c >> 42, (c >> 21) % 2**21, c % 2**21, x] += k
    expected = Counter()
    for t in texts:
        c = (0, 0, 0, *(ord(x) + 1 for x in t))
        expected.update(c[i:i + 4] for i in range(len(t)))
    assert found == expected
    keys = np.array([[(a << 42) | (b << 21) | c, d] for a, b, c, d in found]).T
    places = perplexity.symbols(texts)
    logs = perplexity.log_lookup(*places, *keys, np.arange(len(found), dtype=float)[None])[0]
    order = list(found)
    assert [order[int(x)][3] for x in logs] == [ord(x) + 1 for t in texts for x in t]


def test_quality_has_a_model_for_each_of_many_languages(spark):
    names = [f"l{i}" for i in range(10)]
    rows, text = language_rows(names)
    # the last two languages have the fewest characters
    rows = [r for r in rows if r[2] not in names[8:] or r[0] % 1000 < 30]
    wrong = [(-1, text("l8"), "l9", "a", 0), (-2, text("l9"), "l8", "a", 0)]
    kept = {r.doc_id: r.kept for r in perplexity.judge(documents(spark, rows + wrong)).collect()}
    assert not kept[-1] and not kept[-2]


def test_quality_tells_letters_beyond_a_to_z_apart(spark):
    rows, text = language_rows(["ru", "other"])
    cyrillic = str.maketrans("aeinorst", "аеинорст")
    rows = [(d, t.translate(cyrillic), x, s, n) for d, t, x, s, n in rows if x == "ru"]
    wrong = (-1, text("other").translate(cyrillic), "ru", "a", 0)
    kept = {r.doc_id: r.kept for r in perplexity.judge(documents(spark, [*rows, wrong])).collect()}
    assert not kept[-1] and all(kept[r[0]] for r in rows)


def test_quality_odd_rows(spark):
    judged = perplexity.judge(documents(spark, clash=True)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == Counter(
        (r[0], *slow_base(r[1])) for r in ROWS)
    assert not any(r.kept and r.base_failed for r in judged)
    assert perplexity.judge(documents(spark, [])).count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "and", "of", "water", "river", "stone", "house", "green", "with", "under"]
    prose = [(i, " ".join(rng.choice(vocabulary, 60 + i % 40)) + ".", "en", "a", 0) for i in range(200)]
    noise = [(1000 + i, " ".join("".join(rng.choice(list("qxzjk#@$0189")) for _ in range(7)) for _ in range(60)), "en", "a", 0) for i in range(4)]
    kept = {r.doc_id: (r.kept, r.base_failed) for r in perplexity.judge(documents(spark, prose + noise)).collect()}
    assert all(kept[r[0]][0] or kept[r[0]][1] for r in prose)
    assert not any(kept[r[0]][0] for r in noise)


def language_rows(names, n=40):
    """Texts of languages with the same letters, each with its own odds of what letter follows: (rows, a function that makes a text)."""
    rng = np.random.default_rng(3)
    letters = np.array(list("aeinorst"))
    steps = {x: np.cumsum(rng.dirichlet(np.full(8, 0.25), 8) * 0.9 + 0.1 / 8, axis=1) for x in names}

    def text(lang, k=150):
        at, out = 0, []
        for u in rng.random(5 * k):
            at = min(int(np.searchsorted(steps[lang][at], u)), 7)
            out.append(letters[at])
        return " ".join("".join(out[i:i + 5]) for i in range(0, 5 * k, 5)) + "."

    return [(1000 * i + j, text(x), x, "a", 0) for i, x in enumerate(names) for j in range(n)], text


def test_quality_scores_a_text_by_its_own_language(spark):
    rows, text = language_rows(["en", "fr", "de"])
    wrong = [(-1 - i, text(x), y, "a", 0) for i, (x, y) in enumerate([("fr", "en"), ("de", "fr"), ("en", "de")])]
    passage = [(-10, text("en", 180) + text("fr", 20) + text("en", 100), "en", "a", 0)]
    kept = {r.doc_id: r.kept for r in perplexity.judge(documents(spark, rows + wrong + passage)).collect()}
    assert not any(kept[r[0]] for r in wrong)
    assert kept[-10] and all(kept[r[0]] for r in rows)


# --- toxicity ----------------------------------------------------------------

def toxic_corpus(n=400):
    rng = np.random.default_rng(2)
    clean, bad = [f"word{i}" for i in range(80)], ["idiotic", "idiots", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(clean, 8)) for _ in range(rng.integers(1, 12))]
        if i % 4 == 0:
            sentences[rng.integers(len(sentences))] += f" {rng.choice(bad)} x"
        rows.append((i, ". ".join(sentences), "en", "a", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    right = 0
    for (doc, text, *_), (_, _, toxic) in zip(rows, labels):
        score, spans = toxicity.score_text(text, model, {f: f for f in model.weights}, {})
        right += (score >= toxicity.THRESHOLD) == bool(toxic)
        for s in spans:
            assert re.search("idiot|scum", text[s["start"]:s["end"]])
    assert right >= 0.99 * len(rows)
    assert toxicity.score_text("you idiotism", model, {f: f for f in model.weights}, {})[0] > 0.3  # an inflection not seen


def test_toxicity_gradient_follows_the_likelihood():
    bags = [(1, [[0], [1]]), (1, [[0]]), (0, [[1]]), (0, []), (0, [[1], [1]])]
    model = toxicity._maximise(["bad", "good"], bags, 500)
    assert model.weights["bad"] > model.weights["good"] and 0 < model.leak < 0.3


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (6, 1, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, clash=True)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() <= len(ROWS)
    assert toxicity.reject(documents(spark, []), labels.limit(0)).count() == 0
    assert toxicity.reject(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.score_text(None, toxicity.Model(), {}, {}) == (0.0, [])


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    other = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents(spark, rows), table) == toxicity.fit(documents(spark, rows), other)


# --- pipeline ------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "mixing", "byte_bpe"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = corpus_pipeline.cut_lineage(stages["toxicity"](spark, docs, sf_dir))
    assert clean.columns == docs.columns
    expected = {d for d, t in own.items() if toxicity.score_text(t, model, {f: f for f in model.weights}, {})[0] < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == expected
    lines = corpus_pipeline.cut_lineage(stages["line_dedup"](spark, clean, sf_dir))
    deduped = slow_dedup([(d, own[d]) for d in expected])
    got = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == docs.columns and got == {d: deduped[d, own[d]] for d in expected}
    one = corpus_pipeline.cut_lineage(stages["simhash"](spark, lines, sf_dir))
    prints = [(d, slow_fingerprint(t)) for d, t in got.items()]
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(slow_components(prints).values()))
    mixed = corpus_pipeline.cut_lineage(stages["mixing"](spark, one, sf_dir))
    plan = {r.doc_id: r.repeats for r in mixing.plan(one).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +Counter(plan)
    last = stages["byte_bpe"](spark, mixed, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter(
        {(d, tuple(TIKTOKEN.encode_ordinary(got[d]))): n for d, n in plan.items() if n})
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_of_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_cover_the_helpers():
    assert "_mix_source" in CLASHING
