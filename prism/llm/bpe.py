"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

1. Texts are split into pre-tokens in blocks of about ``BLOCK_CHARS`` characters. A block
   keeps its distinct words once and its texts as positions in that list, so a word that
   is everywhere is one row a block, not one row an occurrence. Blocks are written once as a
   table bucketed by block.
2. The words are exploded with block and position and shuffled by word; each distinct
   word is encoded once and its ids go back, as one list a block and batch.
3. Ids and texts of a block meet again (the bucketed side is not shuffled), and every
   text is put together by position.

Decoding joins ids with the token-byte table (broadcast: its size is that of the
vocabulary, which the file fixes).

Defined cases: null and empty texts have no ids and decode to nothing; a text longer than
a block is a block of its own; repeated rows and null ids stay as they are; no rows give
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.session import scratch_path

BLOCK_CHARS = 32_000_000
#: Pre-tokens that are put together at once.
SLICE = 500_000
BLOCKS = "block long, words array<string>, doc_ids array<long>, lengths array<int>, positions binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i:i + 1] for i in range(len(word))]
    if len(parts) <= 64:
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long words: the same order of merges from a heap over linked parts
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != length:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(parts):
                pair = parts[k] + parts[after[k]]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, k, len(pair)))
    return [ranks[p] for p in parts if p]


def _seven_bits(positions: np.ndarray) -> bytes:
    at = positions.astype(np.uint32)
    sizes = 1 + sum((at >> np.uint32(7 * k) > 0).astype(np.int8) for k in range(1, 5))
    coded = np.stack([((at >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) for k in range(5)], axis=1)
    coded[np.arange(1, 6) < sizes[:, None]] |= np.uint8(128)
    return coded[np.arange(5) < sizes[:, None]].tobytes()


def _pack(positions: np.ndarray) -> bytes:
    """Positions with seven bits a byte (common words have small positions), compressed."""
    parts = [_seven_bits(positions[i:i + SLICE]) for i in range(0, len(positions), SLICE)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(packed: bytes) -> np.ndarray:
    coded = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    ends = np.flatnonzero(coded < 128).astype(np.uint32)
    positions = np.zeros(len(ends), np.uint32)
    for i in range(0, len(ends), SLICE):
        last = ends[i:i + SLICE].astype(np.int64)
        first = np.concatenate([[int(ends[i - 1]) + 1 if i else 0], last[:-1] + 1])
        for k in range(5):
            here = np.flatnonzero(last - first >= k)
            positions[i + here] |= (coded[first[here] + k].astype(np.uint32) & np.uint32(127)) << np.uint32(7 * k)
    return positions


def _block(number: int, words: dict[str, int], docs: list, lengths: list[int], places: array) -> pa.RecordBatch:
    at = np.frombuffer(places, np.uint32)
    by_count = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[by_count] = np.arange(len(words), dtype=np.uint32)
    listed = pa.array(list(words), pa.string()).take(pa.array(by_count))
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(words)], listed),
        pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
        pa.array([_pack(rank[at])], pa.binary())], ["block", "words", "doc_ids", "lengths", "positions"])


def _blocks(pattern: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        words, docs, lengths, places, chars = {}, [], [], array("I"), 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if docs and chars + len(text) > block_chars:
                    yield _block(number, words, docs, lengths, places)
                    words, docs, lengths, places, chars, number = {}, [], [], array("I"), 0, number + 1
                found = split(text)
                for word in found:
                    if word not in words:
                        words[word] = len(words)
                places.extend(map(words.__getitem__, found))
                docs.append(doc.as_py())
                lengths.append(len(found))
                chars += len(text)
        if docs:
            yield _block(number, words, docs, lengths, places)

    return run


def _encode_words(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # sorted by word: each run of equal words is encoded once, also one that goes on in the next batch
            words = batch["word"]
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
            runs = []
            for word in words.filter(pa.array(new)).to_pylist():
                if word != last:
                    last, ids = word, encode_word(word.encode("utf-8", "surrogatepass"), ranks.value)
                runs.append(ids)
            size_of = np.fromiter(map(len, runs), np.int64, len(runs))
            flat = np.fromiter(chain.from_iterable(runs), np.int32, int(size_of.sum()))
            # the rows of a block together
            block = batch["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            block, row = block[order], (np.cumsum(new) - 1)[order]
            sizes = size_of[row]
            found = _gather((np.cumsum(size_of) - size_of)[row], sizes, flat)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [n]])
            upto = np.concatenate([[0], np.cumsum(sizes)])
            places = batch["at"].to_numpy()[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[edges[:-1]], pa.int64())] + [
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
                    for at, values in ((edges, places), (edges, sizes), (upto[edges], found))], ["block", "places", "sizes", "ids"])

    return run


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _assemble(table):
    """Function of a block's texts and its words' ids: the ids of each text, by position, and with
    ``table`` (token bytes by id) also the bytes that these ids decode to."""
    def run(texts: pa.Table, chunks: pa.Table) -> pa.Table:
        places, sizes, flat = (_flat(chunks[c]) for c in ("places", "sizes", "ids"))
        size_of, start_of = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        size_of[places], start_of[places] = sizes, np.cumsum(sizes) - sizes
        out = []
        for row in range(texts.num_rows):
            at, lengths = _unpack(texts["positions"][row].as_py()), _flat(texts["lengths"].slice(row, 1)).astype(np.int64)
            docs, ends = texts["doc_ids"][row].values, np.cumsum(lengths)
            first = 0
            while first < len(lengths):
                start = ends[first] - lengths[first]
                last = max(first + 1, int(np.searchsorted(ends, start + SLICE, "right")))
                here = at[start:ends[last - 1]]
                counts = size_of[here]
                ids = _gather(start_of[here], counts, flat)
                upto = np.concatenate([[0], np.cumsum(counts)])
                offsets = upto[np.concatenate([[0], ends[first:last] - start])]
                done = {"doc_id": docs.slice(first, last - first),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
                if table is not None:
                    done["decoded"] = decode_ids(done["ids"], table.value)
                out.append(pa.table(done))
                first = last
        empty = {"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))}
        return pa.concat_tables(out) if out else pa.table(empty | ({} if table is None else {"decoded": pa.array([], pa.binary())}))

    return run


@dataclass
class TokenBytes:
    """The token-byte table: the bytes of every id, one after another, with their places."""

    starts: np.ndarray
    sizes: np.ndarray
    data: np.ndarray


def decode_ids(ids: pa.ListArray, table: TokenBytes) -> pa.Array:
    """The bytes of each list of ids."""
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
    sizes = table.sizes[flat]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    tokens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = upto[np.concatenate([[0], np.cumsum(tokens)])].astype(np.int32)
    data = [_gather(table.starts[flat[i:i + SLICE]], sizes[i:i + SLICE], table.data) for i in range(0, len(flat), SLICE)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *data]))]
    return pa.Array.from_buffers(pa.binary(), len(ids), buffers)


def token_bytes(ranks: dict[bytes, int]) -> TokenBytes:
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
    return TokenBytes(np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(by_id), np.uint8))


def _bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks as a written table bucketed by block; its catalog entry is dropped again, the files stay."""
    spark = blocks.sparkSession
    path = scratch_path(spark, "bpe-blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block")
     .saveAsTable(name))
    table = spark.table(name)
    table.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS,
           decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` of every document; with ``decoded`` also the bytes that the ids
    decode to, from the task that has them (a second Python worker a task costs memory)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    blocks = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                       .mapInArrow(_blocks(pattern, block_chars), BLOCKS))
    words = blocks.select("block", F.posexplode("words").alias("at", "word")).select("word", "block", "at")
    chunks = (words.repartition("word").sortWithinPartitions("word")
              .mapInArrow(_encode_words(shared), "block long, places array<int>, sizes array<int>, ids array<int>"))
    texts = blocks.select("block", "doc_ids", "lengths", "positions")
    table = spark.sparkContext.broadcast(token_bytes(ranks)) if decoded else None
    return texts.groupBy("block").cogroup(chunks.groupBy("block")).applyInArrow(
        _assemble(table), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(spark: SparkSession, tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of its ``ids``."""
    table = spark.sparkContext.broadcast(token_bytes(ranks))

    @F.arrow_udf("binary")
    def join_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield decode_ids(ids, table.value)

    return tokens.withColumn("decoded", join_bytes(F.col("ids")))
