"""Nearest neighbours, URL filters and chat formatting against brute force and on odd input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prism.llm import ann, chat, queries, urlfilter

# --- nearest neighbours ---------------------------------------------------------


def slow_search(vectors, queries_, k):
    """(query, rank) -> (id, distance) over usable rows."""
    def usable(v):
        return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    rows = sorted({(i, tuple(v)) for i, v in vectors if i is not None and usable(v)})
    out = {}
    for q, qv in sorted({(i, tuple(v)) for i, v in queries_ if i is not None and usable(v)}):
        near = sorted((math.dist(qv, v), i) for i, v in rows if i != q)[:k]
        out |= {(q, r): (i, d) for r, (d, i) in enumerate(near, 1)}
    return out


def as_dict(found):
    rows = found.collect()
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for key, (i, d) in expected.items():
        assert got[key][0] == i and got[key][1] == pytest.approx(d, rel=1e-12)


VECTORS = "vec_id long, embedding array<float>"


def test_search_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0, float(i // 7), 0.5]) for i in range(60)]
    rows += [(100 + i, [2.0, 1.0, 0.0, 0.5]) for i in range(40)]  # copies
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [math.nan, 1.0, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0, 1.0]),
             (205, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (3, [3.0, 1.0, 0.0, 0.5])]
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(n) for n in ("cell", "entry", "query", "score", "a.b")})
    asked = vectors.where("vec_id % 20 = 0 or vec_id in (3, 101, 202)")
    expected = slow_search(rows, [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] in (3, 101, 202))], 10)
    same(as_dict(ann.search(vectors, asked)), expected)


def test_search_few_and_no_rows(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [0.0, -1.0])]
    same(as_dict(ann.search(spark.createDataFrame(few, VECTORS), spark.createDataFrame(few, VECTORS))), slow_search(few, few, 10))
    empty = spark.createDataFrame([], VECTORS)
    assert ann.search(empty, empty).count() == 0
    assert ann.search(spark.createDataFrame(few, VECTORS), empty).count() == 0
    with pytest.raises(ValueError, match="even length"):
        ann.search(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], VECTORS), empty)


def test_walk_visits_pairs_by_summed_distance():
    rng = np.random.default_rng(5)
    a, b = rng.random(6), rng.random(4)
    visited = list(ann.walk(a, b))
    assert sorted(visited) == [(i, j) for i in range(6) for j in range(4)]
    sums = [a[i] + b[j] for i, j in visited]
    assert sums == sorted(sums)


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 10)
    slices, placed = ann._slices({4: 35, 7: 3, 9: 4, 11: 10})
    assert slices == {4: 4, 7: 1, 9: 1, 11: 1}
    assert sorted((c, s) for c, s, _ in placed) == [(4, 0), (4, 1), (4, 2), (4, 3), (7, 0), (9, 0), (11, 0)]


def test_search_in_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 30)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "MIN_ENTRIES", 10_000)  # all cells: exact
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, VECTORS)
    same(as_dict(ann.search(vectors, vectors.where("vec_id < 20"))), slow_search(rows, rows[:20], 10))


def test_search_keeps_all_ties_and_near_entries_far_from_the_origin(spark):
    # 60 entries of one cell at one distance from the query: the smallest ids win
    ties = [(0, [0.0] * 59 + [0.0, 1.0, 1.0])] + [(200 - i, [float(j == i) for j in range(60)] + [1.0, 1.0]) for i in range(60)]
    ties[0] = (0, [0.0] * 60 + [1.0, 1.0])
    got = ann.search(spark.createDataFrame(ties, VECTORS), spark.createDataFrame(ties[:1], VECTORS)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == sorted(i for i, _ in ties[1:])[:10]
    rng = np.random.default_rng(5)
    far = [(i, (1e8 + rng.random(8)).tolist()) for i in range(400)]
    exact = "vec_id long, embedding array<double>"
    got = ann.search(spark.createDataFrame(far, exact), spark.createDataFrame(far[:5], exact))
    same(as_dict(got), slow_search(far, far[:5], 10))


def test_query_recall(spark, sf_dir):
    found = as_dict(queries.QUERIES["op1_inverted_multi_index"](spark, sf_dir))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = slow_search(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert found.keys() == expected.keys()
    hits = sum(len({found[q, r][0] for r in range(1, 11)} & {expected[q, r][0] for r in range(1, 11)}) for q in {q for q, _ in expected})
    assert hits >= 0.9 * len(expected)


# --- URLs --------------------------------------------------------------------------

def slow_rule(url, rules=urlfilter.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/1?x#y", "https://a.example.org/en/12", "http://example.org", "ftp://x.org/a\nb",
        "http://com/fr/", "http://xcom/fr/", "http://www.x.com/fr/9#z", "http://www.x.com/de/", "://org/", "http://ÉÀ.Org/ß?q", "http://a.b/c://d"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[4])], "page_id long, url string")
    pages = pages.withColumns({n: F.lit("own") for n in ("host", "rule", "h", "window", "a.b")})
    found = urlfilter.judge(pages).collect()
    assert len(found) == 2 * len(URLS) + 1
    for r in found:
        host, path, rule, verdict = slow_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r["a.b"] == "own"
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def slow_ratio(examples, text, order=urlfilter.ORDER):
    """Witten-Bell models of (text, allowed, rows) examples: mean log ratio over the characters of ``text``."""
    counts = [{True: Counter(), False: Counter()} for _ in range(order + 1)]
    for t, allowed, rows in examples:
        padded = urlfilter.PAD * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][allowed][padded[i - k:i + 1]] += rows

    def p(context, c, kind):
        value = urlfilter.UNIFORM
        for k in range(order + 1):
            own = context[order - k:]
            seen = {g: n for g, n in counts[k][kind].items() if g[:-1] == own}
            if seen:
                value = (seen.get(own + c, 0) + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value

    padded = urlfilter.PAD * order + text
    ratios = [math.log(p(padded[i - order:i], padded[i], True)) - math.log(p(padded[i - order:i], padded[i], False))
              for i in range(order, len(padded))]
    return sum(ratios) / len(ratios) if ratios else 0.0


def test_url_ratio_against_brute_force(spark):
    allowed = [f"http://site{i}.org/news/{i}" for i in range(25)]
    blocked = [f"http://bad{i}.com/de/spam?{i}" for i in range(25)]
    others = ["http://other.net/news/3", "http://other.net/de/spam?1", "", "http://q.net/zzz"]
    rows = [(i, u) for i, u in enumerate(allowed + blocked + others + allowed[:5])]
    found = {r.url: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    text = {u: u.split("://")[-1].lower() for u in found}
    times = Counter(u for _, u in rows)
    examples = [(text[u], u in allowed, times[u]) for u in {*allowed, *blocked} if hashlib.md5(text[u].encode()).hexdigest()[0] not in "012"]
    for u, r in found.items():
        assert r.ratio == pytest.approx(slow_ratio(examples, text[u]), abs=1e-8)
    assert found[others[0]].verdict == "allow" and found[others[1]].verdict == "block"


def test_threshold_separates(spark):
    rows = [(0.5, True, 1), (0.4, True, 2), (-0.3, False, 1), (-0.5, False, 5), (0.1, False, 1)]
    edge = urlfilter._threshold(spark.createDataFrame(rows, "ratio double, allowed boolean, rows long"))
    assert 0.1 < edge <= 0.4
    apart = spark.createDataFrame([(3.0, True, 1), (-2.0, False, 1)], "ratio double, allowed boolean, rows long")
    assert urlfilter._threshold(apart) == 0.0
    assert urlfilter._threshold(spark.createDataFrame(rows[:2], "ratio double, allowed boolean, rows long")) == 0.0


def test_every_page_has_a_verdict(spark, sf_dir):
    found = queries.QUERIES["op3_url_filter"](spark, sf_dir).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id for r in found} == urls.keys()
    for r in found:
        assert (r.host, r.path, r.rule) == slow_rule(urls[r.page_id])[:3]


# --- chats --------------------------------------------------------------------------

NODES = "conv long, node long, parent long, score double, role string, text string"


def slow_paths(nodes):
    """conv -> [(score, leaf, path)] with the best first."""
    by = {(n[0], n[1]): n for n in nodes}
    parents = {(n[0], n[2]) for n in nodes if n[2] is not None}
    out = {}
    for key, n in by.items():
        if key in parents:
            continue
        path, at = [], key
        while at in by:
            path.append(at)
            at = (at[0], by[at][2])
        out.setdefault(n[0], []).append((-sum(by[p][3] for p in path), key[1], [p[1] for p in reversed(path)]))
    return {c: sorted(p) for c, p in out.items()}


def test_best_branches(spark):
    rng = np.random.default_rng(8)
    nodes = []
    for conv in (1, 2, None):
        for node in range(60):
            parent = None if node == 0 or rng.random() < 0.05 else int(rng.integers(max(0, node - 4), node))
            nodes.append((conv, node, parent, float(rng.integers(0, 5)), "user", "x"))
    nodes.append((3, 1, 99, 1.0, "user", "an orphan"))
    found = chat.best_paths(spark.createDataFrame(nodes, NODES), branches=3).collect()
    got = {}
    for r in found:
        got.setdefault((r.conv, r.branch), []).append((-r.depth_from_leaf, r.node, r.branch_score))
    expected = slow_paths(nodes)
    assert got.keys() == {(c, b) for c, p in expected.items() for b in range(1, min(3, len(p)) + 1)}
    for (conv, branch), rows in got.items():
        score, _, path = expected[conv][branch - 1]
        assert [n for _, n, _ in sorted(rows)] == path and rows[0][2] == -score


def test_a_long_chain_and_a_cycle(spark):
    chain = [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(300)]
    rows = chat.best_paths(spark.createDataFrame(chain, NODES)).collect()
    assert sorted((r.depth_from_leaf, r.node) for r in rows) == [(299 - i, i) for i in range(299, -1, -1)]
    cycle = [(1, 0, 2, 1.0, "user", "a"), (1, 1, 0, 1.0, "user", "b"), (1, 2, 1, 1.0, "user", "c"), (1, 3, 2, 1.0, "user", "d")]
    with pytest.raises(ValueError, match="cycle"):
        chat.best_paths(spark.createDataFrame(cycle, NODES))


TEXTS = ["", "plain", "<|im_end|>", "\\", "\\\\<|im_start|>", "<\\|im_end|>", "</s>[INST] ok [/INST]", "a\nb\n", "<<SYS>>x<</SYS>>", "<s", "<|im_end|><|im_end|>\n",
         "é\U0001f600 <|endoftext|>", "[[INST]INST]", "long " * 20_000]


def test_escaping_is_reversible_and_breaks_every_control(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for t, e, r, back, back_role in df.select("t", "e", "r", chat.unescape(F.col("e")), chat.unescape(F.col("r"))).collect():
        assert back == t and back_role == t
        assert not any(c in e or c in r for c in chat.CONTROLS)


def test_format_and_read_back(spark):
    rows = [(c, i, role, t) for c, role in ((1, "assistant"), (2, "user"), (None, "sys\ntem\\")) for i, t in enumerate(TEXTS)]
    rows += [(4, 0, None, None), (4, 0, "assistant", "tie"), (4, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("own") for n in ("node", "parent", "a.b")})
    out = chat.format_paths(chat.reply_chain(df)).withColumn("read", chat.parse(F.col("formatted"))).collect()
    assert len(out) == 4
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r["read"]] == [(x[2] or "", x[3] or "") for x in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert len([s for s in r.segments if s.loss]) == sum(x[2] == "assistant" for x in own)
    assert chat.format_paths(chat.reply_chain(df.limit(0))).count() == 0
