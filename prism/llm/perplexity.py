"""Quality rules with n-gram perplexity.

Language model: modified Kneser-Ney over 4-grams of whole code points, one model a language,
counted by Spark over all texts. The counts, the contexts and the probabilities are tables
keyed by (language, n-gram) that grow with the corpus and are joined in Spark; nothing of
them is broadcast or collected, and neither languages nor n-grams are capped. Discounts D1,
D2, D3+ come from the counts of counts of each order; lower orders use continuation counts.
Texts are dealt into blocks of about ``BLOCK`` characters, packed by block and compressed before
they are shuffled; each block's distinct n-grams get their log probabilities by a join, and the
block is scored beside them.

A document is rejected if it fails the base rules (too few words, too many words in
repeated 8-word windows) or if its perplexity lies outside its language's band. A text is
scored by its own language's model. A short passage in another language is no lack of quality,
so at most ``FOREIGN`` of a text's segments, those that gain most, count with the model
of all languages together where that fits better. Bands are quartiles of log perplexity over the documents that pass the base rules, widened by ``WIDTH``
interquartile ranges on either side. The band also allows for the length of a text, as
the mean over n characters scatters with 1 / sqrt(n).

Defined cases: null and empty texts have no words, fail the base rules and have no
perplexity; a null language is a language of its own; a band needs two
documents, else all pass; repeated rows are judged alike; no rows give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.session import cut_lineage

ORDER = 4
CLASSES = 32
#: Languages whose class counts a task holds at once (then they go out; no cap).
HELD = 16
WIDTH = 3.0
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
#: Characters that are counted at once, and characters of a block of texts.
AT_ONCE, BLOCK = 2_000_000, 16_000_000
#: Bytes of texts that a task holds while it packs them by block.
PACKED = 64_000_000
#: Bits of a symbol: a code point + 1, or 0 for what stands before a text.
BITS = 21
#: Key of the model of all languages; a language's key begins with another sign.
ALL = "*"
#: Characters of a segment, and the share of a text's segments that another model may score.
SEGMENT, FOREIGN = 128, 0.25
#: Characters that the scatter of a short text's mean is taken for.
SCATTER_CHARS = 100.0
#: The symbols that are counted, and the white space that ends words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def character_classes() -> np.ndarray:
    """Class (1..31) of every code point; 0 stands before a text."""
    table = np.full(0x110000, 31, np.uint8)
    for cp in range(0x30000):  # what lies beyond is rare letters, marks and private use
        kind = unicodedata.category(chr(cp))
        table[cp] = {"L": 27, "M": 27, "N": 28, "Z": 29, "P": 30}.get(kind[0], 31)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[[ord(c) for c in "\t\n\x0b\x0c\r"]] = 29
    table[[ord(c) for c in SYMBOLS + "@^_~=+\\/{}[]`"]] = 31
    return table


def codes(text: str, classes: np.ndarray) -> np.ndarray:
    """The code of the 4-gram that ends at each character; a text is preceded by class 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([np.zeros(ORDER - 1, np.int64), classes[points].astype(np.int64)])
    n = len(points)
    return ((c[:n] * CLASSES + c[1:n + 1]) * CLASSES + c[2:n + 2]) * CLASSES + c[3:n + 3]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): one row for each 4-gram a language has in the partition."""
    classes, counts, waiting = character_classes(), {}, {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            mine = waiting.setdefault(lang, [])
            mine.append(codes(text.as_py() or "", classes))
            if sum(map(len, mine)) > AT_ONCE:
                _add(counts, lang, waiting.pop(lang))
        if len(counts) + len(waiting) > HELD:  # bounded memory: what is held goes out
            for lang in list(waiting):
                _add(counts, lang, waiting.pop(lang))
                yield from _flush(counts)
    for lang in list(waiting):
        _add(counts, lang, waiting.pop(lang))
    yield from _flush(counts)


def _add(counts: dict, lang: str, found: list[np.ndarray]) -> None:
    new = np.bincount(np.concatenate(found), minlength=CLASSES**ORDER)
    counts[lang] = counts[lang] + new if lang in counts else new


def _flush(counts: dict) -> Iterator[pa.RecordBatch]:
    for lang, mine in counts.items():
        grams = np.flatnonzero(mine)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.int64()),
                                          "n": pa.array(mine[grams], pa.int64())})
    counts.clear()


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D of counts 0, 1, 2, 3 and more."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def hash_of(gram: np.ndarray, order: int) -> np.ndarray:
    """64-bit multiplicative hash of an n-gram and its order (one to one: the factor is odd)."""
    return ((gram * 8 + order).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """4-gram codes and counts of one language -> sorted hashes of all n-grams of order 1 to 4
    with log probability, and of their contexts with the weight of the lower order."""
    levels = {ORDER: (grams, counts)}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: by how many classes a gram is preceded
        above, _ = levels[order + 1]
        levels[order] = np.unique(above % CLASSES**order, return_counts=True)
    seen = len(levels[1][0])
    hashes, logs, contexts, weights = [], [], [], []
    lower = np.full(CLASSES, 1.0 / CLASSES)  # by gram of the order below; order 0: uniform
    for order in range(1, ORDER + 1):
        gram, n = levels[order]
        d = _discounts(n)
        context, at = np.unique(gram // CLASSES, return_inverse=True)
        total = np.bincount(at, n)
        reserved = np.bincount(at, d[np.minimum(n, 3)]) / total
        below = lower[gram % CLASSES] if order == 1 else lower[np.searchsorted(levels[order - 1][0], gram % CLASSES**(order - 1))]
        p = (n - d[np.minimum(n, 3)]) / total[at] + reserved[at] * below
        hashes.append(hash_of(gram, order))
        logs.append(np.log(p))
        contexts.append(hash_of(context, order))
        weights.append(np.log(np.maximum(reserved, 1e-12)))
        lower = p
    model = {}
    for name, key, value in (("gram", hashes, logs), ("context", contexts, weights)):
        key, value = np.concatenate(key), np.concatenate(value)
        by = np.argsort(key)
        model[f"{name}_hash"], model[f"{name}_log"] = key[by], value[by].astype(np.float32)
    model["seen"] = np.array([seen])
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(model: dict[str, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """Natural log probability of the last class of each 4-gram code given the three before it."""
    out, weight, open_ = np.zeros(len(gram)), np.zeros(len(gram)), np.ones(len(gram), bool)
    for order in range(ORDER, 0, -1):
        g = gram % CLASSES**order
        at, there = _find(model["gram_hash"], hash_of(g, order))
        done = open_ & there
        out[done] = (weight + model["gram_log"][at])[done]
        open_ &= ~there
        at, there = _find(model["context_hash"], hash_of(g // CLASSES, order))
        weight += np.where(open_ & there, model["context_log"][at], 0.0)
    out[open_] = weight[open_] - np.log(CLASSES)
    return out


def spared_mean(own: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> float:
    """Mean negative log probability of a text from its segments' sums under its own language's
    model; at most ``FOREIGN`` of the segments, those that gain most, count with ``other``."""
    gain = np.maximum(other - own, 0)
    spared = int(FOREIGN * len(own))
    best = np.sort(gain)[len(gain) - spared:].sum()
    return float(-(own.sum() + best) / sizes.sum())


def model_of(docs: DataFrame) -> dict[str | None, dict[str, np.ndarray]]:
    """The same estimator over character classes, in memory, one model for each language; for
    small corpora (:func:`judge` uses :func:`probabilities`)."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    counted = cut_lineage(docs.select(lang.alias("lang"), "text").mapInArrow(_count, "lang string, gram long, n long")
                          .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lm-counts")
    found = counted.orderBy("lang", "gram").toArrow()
    langs, grams, ns = found["lang"].to_numpy(zero_copy_only=False), found["gram"].to_numpy(), found["n"].to_numpy()
    return {name: kneser_ney(grams[langs == name], ns[langs == name]) for name in dict.fromkeys(langs.tolist())}


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each behind ORDER - 1 zeros, and the places of their characters."""
    pad = "\0" * (ORDER - 1)
    flat = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes  # of each text's characters
    for k in range(1, ORDER):
        flat[starts - k] = 0
    return flat, np.flatnonzero(flat)


def _numbered(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The symbols around the places, which of them are used, and the bits that number those."""
    near = flat[at[0] - ORDER + 1:at[-1] + 1]
    used = np.zeros(int(near.max()) + 1, bool)
    used[near] = True
    return near, used, max(1, int(used.sum() - 1).bit_length())


def _pack(near: np.ndarray, at: np.ndarray, used: np.ndarray, bits: int) -> np.ndarray:
    """The 4-gram that ends at each place, of the numbers of its symbols."""
    dense = (np.cumsum(used, dtype=np.int64) - 1)[near]
    key = dense[:-ORDER + 1].copy()
    for back in range(ORDER - 2, -1, -1):
        key <<= bits
        key |= dense[ORDER - 1 - back:len(dense) - back]
    return key if len(key) == len(at) else key[at - at[0]]


def grams(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, last symbol, count) of the distinct 4-grams that end at the places. Symbols are
    numbered densely so that a 4-gram fits 62 bits; places with too many symbols are halved."""
    if not len(at):
        return
    near, used, bits = _numbered(flat, at)
    if ORDER * bits > 62:
        yield from grams(flat, at[:len(at) // 2])
        yield from grams(flat, at[len(at) // 2:])
        return
    symbol = np.flatnonzero(used)
    key, n = np.unique(_pack(near, at, used, bits), return_counts=True)
    parts = [symbol[(key >> (bits * back)) & ((1 << bits) - 1)] for back in range(ORDER - 1, -1, -1)]
    context = np.zeros(len(key), np.int64)
    for part in parts[:-1]:
        context = (context << BITS) | part
    yield context, parts[-1], n


def log_lookup(flat: np.ndarray, at: np.ndarray, context: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The row of ``values`` (columns beside context and last, which are distinct) of the 4-gram at each place."""
    out = np.empty((values.shape[0], len(at)), np.float64)
    if not len(at):
        return out
    near, used, bits = _numbered(flat, at)
    if ORDER * bits > 62:
        half = len(at) // 2
        out[:, :half], out[:, half:] = (log_lookup(flat, a, context, last, values) for a in (at[:half], at[half:]))
        return out
    parts = [(context >> (BITS * back)) & ((1 << BITS) - 1) for back in range(ORDER - 2, -1, -1)] + [last]
    own = np.logical_and.reduce([used[np.minimum(p, len(used) - 1)] & (p < len(used)) for p in parts])
    number = np.cumsum(used, dtype=np.int64) - 1
    table = np.zeros(int(own.sum()), np.int64)
    for part in parts:
        table = (table << bits) | number[part[own]]
    found = pc.index_in(pa.array(_pack(near, at, used, bits)), value_set=pa.array(table))
    if found.null_count:
        raise ValueError("a text has n-grams that were not counted")
    return values[:, own][:, found.to_numpy()]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(key, text) -> (key, texts), about AT_ONCE characters at once."""
    waiting, held = {}, 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = tuple(key.values()) if isinstance(key, dict) else key
            text = text.as_py()
            if text:
                waiting.setdefault(key, []).append(text)
                held += len(text)
            if held > AT_ONCE:
                yield from waiting.items()
                waiting, held = {}, 0
    yield from waiting.items()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, context, last, n), summed within about AT_ONCE characters."""
    for key, texts in _by_language(batches):
        for context, last, n in grams(*symbols(texts)):
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()).take(pa.array(np.zeros(len(n), np.int32))),
                                              "context": pa.array(context, pa.int64()), "last": pa.array(last, pa.int32()),
                                              "n": pa.array(n, pa.int64())})


def probabilities(texts: DataFrame) -> DataFrame:
    """(key, text) -> key, context, last, p: the modified Kneser-Ney probability of every 4-gram
    of each key, and of the key ALL, which has the counts of all keys together."""
    counted = cut_lineage(texts.mapInArrow(_gram_counts, "key string, context long, last int, n long")
                          .groupBy("key", "context", "last").agg(F.sum("n").alias("n")), "lm-counts")
    level = cut_lineage(counted.unionByName(counted.groupBy("context", "last").agg(F.sum("n").alias("n"))
                                            .select(F.lit(ALL).alias("key"), "context", "last", "n")), "lm-order-4")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: by how many symbols a gram is preceded
        kept = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1).cast("long"))
        level = cut_lineage(level.groupBy("key", kept.alias("context"), "last").agg(F.count(F.lit(1)).alias("n")), f"lm-order-{order}")
        levels[order] = level
    below = levels[1].groupBy("key").agg((1 / (F.count(F.lit(1)) + 1)).alias("lower"))  # order 0: uniform
    for order in range(1, ORDER + 1):
        ns = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
        n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.0)]
        known = (n1 > 0) & (n2 > 0)
        d = [F.when(known, F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05))).otherwise(0.5).alias(f"d{k}") for k, x in enumerate(d, 1)]
        discounts = cut_lineage(levels[order].groupBy("key").agg(*ns).select("key", *d), "lm-discounts")  # a row a language
        n = F.col("n")
        contexts = levels[order].groupBy("key", "context").agg(
            F.sum("n").alias("total"), F.count_if(n == 1).alias("c1"), F.count_if(n == 2).alias("c2"), F.count_if(n > 2).alias("c3"))
        contexts = contexts.join(discounts, "key").withColumn(
            "reserved", (F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")) / F.col("total"))
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = levels[order].join(contexts, ["key", "context"])
        if order == 1:
            rows = rows.join(below, "key")
        else:
            kept = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1).cast("long"))
            lower = below.select("key", F.col("context").alias("shorter"), "last", F.col("p").alias("lower"))
            rows = rows.withColumn("shorter", kept).join(lower, ["key", "shorter", "last"])
        p = (n - cut) / F.col("total") + F.col("reserved") * F.col("lower")
        below = cut_lineage(rows.select("key", "context", "last", p.alias("p")), f"lm-p{order}")
    return below


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that the text holds twice or more, the first included.
    Windows are named exactly by doubling: 1, 2, 4, ... words get a number each, as long as any come again."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    name = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - 1 - width // 2:  # too few words come again for a window to do so
        return 0
    length = 1
    while length < width:
        step = min(length, width - length)
        pair = name[:len(name) - step] * (n + 1) + name[step:]
        known = np.sort(pair)
        if not (known[1:] == known[:-1]).any():
            return 0
        name = np.searchsorted(known, pair)
        length += step
    again = np.bincount(name)[name] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, duplicates = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                if line in seen:
                    duplicates += 1
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates,
            repeated_window_words(words))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, block) -> (block, texts): rows of (doc_id, key, text) of one block, as one compressed Arrow stream."""
    waiting, held = {}, 0
    for batch in batches:
        block = batch.column(3).to_numpy(zero_copy_only=False)
        by = np.argsort(block, kind="stable")
        rows, block = batch.select([0, 1, 2]).take(pa.array(by)), block[by]
        ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
        for first, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            if end > first:
                waiting.setdefault(int(block[first]), []).append(rows.slice(first, end - first))
        held += rows.nbytes
        if held > PACKED:
            yield from _streams(waiting)
            waiting, held = {}, 0
    yield from _streams(waiting)


def _streams(waiting: dict[int, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3), use_threads=False)
    for block, rows in waiting.items():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=how) as stream:
            stream.write_table(pa.Table.from_batches(rows).combine_chunks())
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(packs: pa.Table) -> pa.Table:
    """doc_id, key and text of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs["texts"]])


def _block_grams(packs: pa.Table) -> pa.Table:
    """(block, texts) of a block -> its distinct (block, key, context, last)."""
    found = [pa.table({"key": pa.array([key], pa.string()).take(pa.array(np.zeros(len(n), np.int32))),
                       "context": pa.array(context, pa.int64()), "last": pa.array(last, pa.int32())})
             for key, texts in _by_language(_unpacked(packs).select(["key", "text"]).to_batches())
             for context, last, n in grams(*symbols(texts))]
    empty = pa.table({"key": pa.array([], pa.string()), "context": pa.array([], pa.int64()), "last": pa.array([], pa.int32())})
    rows = pa.concat_tables([empty, *found]).group_by(["key", "context", "last"], use_threads=False).aggregate([])
    return rows.add_column(0, "block", pa.array(np.full(len(rows), packs["block"][0].as_py(), np.int32)))


SCORED = "doc_id long, key string, " + "".join(f"{f} long, " for f in BASE_FIELDS) + "log_ppl double, chars long"


def _score(packs: pa.Table, models: pa.Table) -> pa.Table:
    """The documents of a block with their base counts and mean negative log probability."""
    docs = _unpacked(packs)
    texts = [t or "" for t in docs["text"].to_pylist()]
    keys, logs = np.array(docs["key"].to_pylist(), object), np.full(len(texts), np.nan)
    owners = models["key"].to_numpy() if models.num_rows else np.array([], object)
    context, last = (models[c].to_numpy().astype(np.int64) for c in ("context", "last"))
    values = np.stack([models[c].to_numpy() for c in ("own", "other")])
    for key in dict.fromkeys(keys.tolist()):
        mine = owners == key
        table = context[mine], last[mine], values[:, mine]
        rows = np.array([i for i in np.flatnonzero(keys == key) if texts[i]], np.int64)
        ends = np.cumsum([len(texts[i]) for i in rows])
        for part in np.split(rows, np.flatnonzero(np.diff(ends // AT_ONCE)) + 1) if len(rows) else []:
            own, other = log_lookup(*symbols([texts[i] for i in part]), *table)
            first = 0
            for i in part:
                n = len(texts[i])
                starts = np.arange(first, first + n, SEGMENT)
                sums = [np.add.reduceat(x[:first + n], starts) for x in (own, other)]
                logs[i] = spared_mean(*sums, np.diff(np.append(starts, first + n)))
                first += n
    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(BASE_FIELDS))
    return pa.table({"doc_id": docs["doc_id"], "key": docs["key"], **{f: pa.array(counts[:, k]) for k, f in enumerate(BASE_FIELDS)},
                     "log_ppl": pa.array(logs, pa.float64(), from_pandas=True),
                     "chars": pa.array([len(t) for t in texts], pa.int64())})


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the language), the base counts, log_ppl and chars of every document."""
    key = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    p = probabilities(keyed.select("key", "text"))
    own = p.where(F.col("key") != ALL).select("key", "context", "last", F.log("p").alias("own"))
    models = own.join(p.where(F.col("key") == ALL).select("context", "last", F.log("p").alias("other")), ["context", "last"])
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK
    # by text and id: rows that repeat both are few or judged in one block, all else is spread
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = keyed.withColumn("block", block).mapInArrow(_packed, "block int, texts binary").repartition(blocks, "block")
    # both groupings read the shuffle of ``dealt``
    asked = dealt.groupBy("block").applyInArrow(_block_grams, "block int, key string, context long, last int").join(models, ["key", "context", "last"])
    return cut_lineage(dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_score, SCORED), "lm-scores")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, perplexity, its band (lower, upper) and kept."""
    scored = scores(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    quartiles = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    bands = scored.where("not base_failed").groupBy("key").agg(quartiles.alias("q"), F.count("log_ppl").alias("n"))
    spread = F.greatest(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.lit(0.01))
    bands = bands.select("key", F.get("q", F.lit(1)).alias("middle"), (F.get("q", F.lit(0)) - WIDTH * spread).alias("low"),
                         (F.get("q", F.lit(2)) + WIDTH * spread).alias("high"), "n")
    wider = F.sqrt(1 + SCATTER_CHARS / F.greatest("chars", F.lit(1)))
    inside = F.col("log_ppl").between(F.col("middle") + (F.col("low") - F.col("middle")) * wider,
                                      F.col("middle") + (F.col("high") - F.col("middle")) * wider)
    return scored.join(bands, "key", "left").select(
        "doc_id", *BASE_FIELDS, "base_failed", F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("lower"),
        F.exp("high").alias("upper"),
        (~F.col("base_failed") & F.coalesce(inside | (F.col("n") < 2), F.lit(True))).alias("kept"))
