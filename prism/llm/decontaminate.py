"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of digits, letters a-z (A-Z folded) and characters from U+0080 on. The words of the
items are built into suffix automata, in Spark tasks: one automaton for each part of the items,
and a part has at most ``PART_WORDS`` words, which bounds what is sent to the workers (some 20 MB each).
Each document's words are streamed through the automaton once, in the scan's own task, and the length of the
longest match that ends at each word is tracked. Where it reaches ``limit`` words, the
matched words are hit, and so are the words of an item that has fewer words and occurs whole.
:func:`decontaminate` cuts the spans of hit words out and drops documents of which more
than ``max_coverage`` is hit.

No text is shuffled. With several parts the documents are scanned on for each, ``CHAIN`` parts a stage;
between stages they are written to the shared folder. An item of more than ``PIECE`` words is
cut into pieces that overlap by ``limit - 1`` words, so every window of it is whole in a piece
(``longest`` counts up to a piece's end).

Defined cases: a null or wordless text has no words and no spans; an item without words has no
window; a null item_id hits like any other but is not listed; rows that repeat an item_id count as
one item with the windows of all; repeated documents come out alike; without items nothing is hit;
texts of any length are read whole; other columns stay, and a name that clashes is put aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.llm.common import ascii_lower, col, free_name
from prism.session import cut_lineage

LIMIT, MAX_COVERAGE = 10, 0.5
PART_WORDS, PIECE, CHAIN = 200_000, 50_000, 4
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same by UTF-8 bytes: A-Z to lower case, other ASCII characters that are no digit or letter to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """A generalised suffix automaton as arrays.

    State s has the suffix link ``link[s]`` and the longest string ``length[s]``; ``keys[i]`` is
    state * words + word, and leads to ``targets[i]``. ``window[s]`` is the state of the last ``limit`` words of
    the strings of s, ``whole[s]`` the nearest state from s up the links that is a whole short item (0: none).
    The items of such a state are ``owners[owned[s]:owned[s + 1]]``, positions in ``items``.
    """

    words: list
    items: list
    link: np.ndarray
    length: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    window: np.ndarray
    whole: np.ndarray
    owned: np.ndarray
    owners: np.ndarray


AUTOMATON = ("words array<string>, items array<string>, link array<int>, length array<int>, keys array<long>, targets array<int>, "
             "window array<int>, whole array<int>, owned array<int>, owners array<int>")


def build(pieces: list[tuple[str | None, list]], limit: int) -> Automaton:
    """The automaton of the pieces: (item_id, words)."""
    number: dict = {}
    texts = [[number.setdefault(w, len(number)) for w in words] for _, words in pieces]
    link, length, out = [-1], [0], [{}]

    def state(size: int, after: dict, suffix: int) -> int:
        length.append(size)
        out.append(after)
        link.append(suffix)
        return len(link) - 1

    def split(p: int, word: int, q: int) -> int:
        """The state of the strings of q that end p's strings with the word."""
        if length[p] + 1 == length[q]:
            return q
        clone = state(length[p] + 1, dict(out[q]), link[q])
        link[q] = clone
        while p >= 0 and out[p].get(word) == q:
            out[p][word] = clone
            p = link[p]
        return clone

    for text in texts:
        last = 0
        for word in text:
            known = out[last].get(word)
            if known is not None:  # an earlier item has these words
                last = split(last, word, known)
                continue
            p, last = last, state(length[last] + 1, {}, 0)
            while p >= 0 and word not in out[p]:
                out[p][word] = last
                p = link[p]
            if p >= 0:
                link[last] = split(p, word, out[p][word])

    names = sorted({i for i, _ in pieces if i is not None})
    at = {name: i for i, name in enumerate(names)}
    owners, short = set(), set()
    for (item, _), text in zip(pieces, texts):
        s = size = 0
        for word in text:
            s, size = out[s][word], size + 1
            if size > limit:  # only the last words up to the limit
                size = limit
                if length[link[s]] >= limit:
                    s = link[s]
            if size == limit and item is not None:
                owners.add((s, at[item]))
        if 0 < size < limit:
            short.add(s)
            if item is not None:
                owners.add((s, at[item]))
    window, whole = [0] * len(link), [0] * len(link)
    for s in sorted(range(1, len(link)), key=length.__getitem__):
        window[s] = s if length[link[s]] < limit else window[link[s]]
        whole[s] = s if s in short else whole[link[s]]
    of = np.array(sorted(owners), np.int64).reshape(-1, 2)
    return Automaton(
        list(number), names, np.array(link, np.int32), np.array(length, np.int32),
        np.array([s * len(number) + w for s, after in enumerate(out) for w in after], np.int64),
        np.array([t for after in out for t in after.values()], np.int32),
        np.array(window, np.int32), np.array(whole, np.int32),
        np.searchsorted(of[:, 0], np.arange(len(link) + 1)).astype(np.int32), of[:, 1].astype(np.int32))


class Matcher:
    """An automaton in the form in which words are streamed through it."""

    def __init__(self, a: Automaton, limit: int):
        self.limit, self.a = limit, a
        self.number = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(a.words)}
        self.step = dict(zip(a.keys.tolist(), a.targets.tolist()))
        self.link, self.length, self.whole = a.link.tolist(), a.length.tolist(), a.whole.tolist()
        short = a.length[np.unique(a.whole)[1:]] if a.whole.any() else a.length[:0]
        #: no window has fewer words
        self.least = min([limit, *short.tolist()])

    def runs(self, words: list) -> Iterator[tuple[int, list]]:
        """Runs of words that the items have, if long enough for a window: first word's position, word numbers."""
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.least:
                yield a, ids[a:b].tolist()

    def match(self, words: list) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Hit intervals (first word, end, longest match), in order of their ends, and the states of the windows met."""
        step, link, length, whole, n = self.step.get, self.link, self.length, self.whole, len(self.a.words)
        found, met = [], set()
        for first, ids in self.runs(words):
            s = size = 0
            for i, word in enumerate(ids, first + 1):
                after = step(s * n + word)
                while after is None:
                    s = link[s]
                    size = length[s]
                    after = step(s * n + word)  # the root knows every word of the items
                s, size = after, size + 1
                if size >= self.limit:
                    found.append((i - size, i, size))
                    met.add(int(self.a.window[s]))
                if size >= self.least:
                    w = whole[s] if size == length[s] or whole[s] != s else whole[link[s]]
                    if w:
                        found.append((i - length[w], i, length[w]))
                    while w and w not in met:
                        met.add(w)
                        w = whole[link[w]]
        return found, met

    def items(self, met: set[int]) -> set[str]:
        a = self.a
        return {a.items[o] for s in met for o in a.owners[a.owned[s]:a.owned[s + 1]].tolist()}


def union(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of hit words: touching and overlapping intervals joined, with the longest match in each."""
    out: list = []
    for a, b, longest in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(longest, out[-1][2]))
        else:
            out.append((a, b, longest))
    return out


def places(raw: bytes, spans: list[tuple[int, int, int]]) -> Iterator[dict]:
    """The spans with their place in the text, in characters."""
    word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends, at, chars = edge[::2], edge[1::2], 0, 0

    def length(part: bytes) -> int:
        return len(part.decode("utf-8", "replace"))

    for a, b, longest in spans:
        start, end = int(starts[a]), int(ends[b - 1])
        chars += length(raw[at:start])
        size = length(raw[start:end])
        yield {"first": a, "words": b - a, "longest": longest, "start": chars, "chars": size}
        at, chars = end, chars + size


LEAK = "n_words long, spans array<struct<first: int, words: int, longest: int, start: int, chars: int>>, items array<string>"
_LEAK = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct(
    [(n, pa.int32()) for n in ("first", "words", "longest", "start", "chars")]))), ("items", pa.list_(pa.string()))])


def matcher(automaton: Automaton, limit: int = LIMIT):
    """Arrow UDF: text, leak of the parts before (or null) -> leak: struct(n_words, spans, items)."""
    @F.arrow_udf(LEAK)
    def leak(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = Matcher(automaton, limit)
        for texts, earlier in batches:
            out = []
            for text, before in zip(texts.cast(pa.binary()), earlier):
                raw = text.as_py() or b""
                words = raw.translate(WORD_BYTES).split()
                found, met = own.match(words)
                items, before = own.items(met), before.as_py()
                if before and before["spans"]:
                    found += [(s["first"], s["first"] + s["words"], s["longest"]) for s in before["spans"]]
                    items |= set(before["items"])
                out.append({"n_words": len(words), "spans": list(places(raw, union(found))) if found else [], "items": sorted(items)})
            yield pa.array(out, _LEAK)

    return leak.asNondeterministic()  # a filter on the result must not run it twice


def automata(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a part: the suffix automaton of its items (columns item_id, text), built in a task and written."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0)
    step = PIECE - limit + 1
    pieces = (items.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
              .select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - limit), F.lit(step))).alias("at"))
              .select("item", "at", F.slice("words", F.col("at") + 1, F.lit(PIECE)).alias("words")).distinct())
    pieces = cut_lineage(pieces, "leak-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = total // (PART_WORDS // 2) + 1
    while True:  # pieces are distinct and far smaller than a part, so some number of parts does
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "at", "words"), F.lit(parts)))
        most = dealt.groupBy("part").agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= PART_WORDS:
            break
        parts *= 2

    def build_part(rows: pa.Table) -> pa.Table:
        made = build(sorted(zip(rows["item"].to_pylist(), rows["words"].to_pylist()), key=lambda p: (p[0] or "", p[1])), limit)
        values = [getattr(made, f.name) for f in fields(made)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5]
        return pa.table({f.name: pa.array([v], pa.list_(k)) for f, v, k in zip(fields(made), values, kinds)}
                        | {"part": pa.array([rows["part"][0].as_py()], pa.int64())})

    return cut_lineage(dealt.groupBy("part").applyInArrow(build_part, AUTOMATON + ", part long"), "leak-automata")


def find(docs: DataFrame, items: DataFrame, name: str = "leak", limit: int = LIMIT) -> DataFrame:
    """The documents (with a column text) and a column of what they have of the items: struct(n_words, spans, items)."""
    built = automata(items, limit)
    parts = [r["part"] for r in built.select("part").orderBy("part").collect()]
    if not parts:
        parts = [None]
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{LEAK}>"))
    for n, part in enumerate(parts):
        row = None if part is None else built.where(F.col("part") == part).first()
        one = build([], limit) if row is None else Automaton(**{
            f.name: row[f.name] if f.name in ("words", "items") else np.array(row[f.name], np.int64) for f in fields(Automaton)})
        if n and n % CHAIN == 0:
            out = cut_lineage(out, "leak-scanned")
        out = out.withColumn(name, matcher(one, limit)(F.col("text"), col(name)))
    return out


def hit_words(leak: Column) -> Column:
    return F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda n, s: n + s["words"])


def cut(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["start"] + s["chars"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def decontaminate(docs: DataFrame, items: DataFrame, limit: int = LIMIT, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents with the columns they came with: hit spans are cut out of the text, and documents of
    whose words more than ``max_coverage`` are hit go."""
    name = free_name(docs, stem="leak")
    found = find(docs, items, name, limit)
    leak = F.col(name)
    return (found.where(hit_words(leak) <= max_coverage * leak["n_words"])
            .withColumn("text", cut(F.col("text"), leak["spans"])).drop(name))
