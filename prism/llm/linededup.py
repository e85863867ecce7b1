"""Line dedup by content-defined chunks of lines.

A rolling polynomial hash over the hashes of two consecutive lines is taken at every
line; a chunk ends where that hash is a local minimum (below the one before, not above
the one after). So boundaries depend on nearby lines only and come back after an
insertion, and every chunk but a document's last has two lines at least. Runs without a
minimum, such as one line over and over, are cut every ``max_lines`` lines.

Chunks of two lines or more that occur again anywhere in the corpus are removed, except
the first occurrence by (doc_id, text hash, position). Candidates are found by two
64-bit hashes; then the bytes of all occurrences of a hash are compared (their least
and greatest text, combined before the shuffle), and a hash whose occurrences differ
removes nothing.

Defined cases: null text stays null; empty text is one empty line and stays; a document
may lose all its lines and then has an empty text; rows that repeat doc_id and text are
one occurrence and come out alike; null ids come last in the order; no rows give no
rows; other columns are kept. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.llm.common import free_name, of
from prism.session import cut_lineage

MAX_LINES = 32
#: Fixed values of the rolling hash: base and modulus (products stay below 2**63).
BASE, MODULUS = 1_000_003, 2_147_483_647


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _rolled(hashes: Column) -> Column:
    """Rolling hash over each line and the one before it."""
    return F.transform(hashes, lambda h, i: (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * BASE + h) % MODULUS)


def pieces(lines: Column, max_lines: int = MAX_LINES) -> Column:
    """The chunks of an array of lines: array of (start from 0, n)."""
    def cut(rolled: Column) -> Column:
        n = F.size(rolled)
        minima = F.filter(F.sequence(F.lit(1), n - 2), lambda i: (F.get(rolled, i) < F.get(rolled, i - 1))
                          & (F.get(rolled, i) <= F.get(rolled, i + 1)))
        return _let(F.when(n >= 3, minima).otherwise(F.array().cast("array<int>")), lambda ends: F.flatten(F.zip_with(
            F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.concat(ends, F.array(n - 1)),
            lambda first, last: F.transform(F.sequence(first, last, F.lit(max_lines)), lambda s: F.struct(
                s.alias("start"), F.least(F.lit(max_lines), last - s + 1).alias("n"))))))

    return _let(F.transform(lines, _line_hash), lambda hashes: _let(_rolled(hashes), cut))


def _chunk_text(lines: Column, piece: Column) -> Column:
    return F.array_join(F.slice(lines, piece["start"] + 1, piece["n"]), "\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_chunks(docs: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """doc_id, text_hash and ``chunks``, the positions of the chunks to remove."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hashed = _let(_lines(F.col("text")), lambda lines: F.filter(F.transform(
        pieces(lines, max_lines), lambda p, i: F.struct(
            i.alias("seq"), p["n"].alias("n"), F.xxhash64(_chunk_text(lines, p)).alias("h1"),
            F.xxhash64(F.lit("second"), _chunk_text(lines, p)).alias("h2"))), lambda c: c["n"] >= 2))
    chunks = keyed.select("doc_id", "text_hash", F.explode(hashed).alias("c")).select(
        "doc_id", "text_hash", "c.seq", "c.h1", "c.h2")
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "seq")
    again = chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    found = (chunks.join(again, ["h1", "h2"])
             .select("doc_id", "text_hash", F.struct("seq", "h1", "h2", (place == F.col("first")).alias("first")).alias("c")))
    lists = cut_lineage(found.groupBy("doc_id", "text_hash").agg(F.collect_set("c").alias("found")), "line-chunks")
    k, f = keyed.alias("k"), lists.alias("f")
    same = F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("k.text_hash") == F.col("f.text_hash"))
    texts = _let(_lines(F.col("k.text")), lambda lines: _let(pieces(lines, max_lines), lambda ps: F.transform(
        "f.found", lambda c: F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"),
                                      _chunk_text(lines, F.get(ps, c["seq"])).alias("chunk")))))
    # a list for each document has no size bound, so neither join broadcasts it
    differing = (k.join(f.hint("merge"), same).select(F.explode(texts).alias("c")).select("c.h1", "c.h2", "c.chunk")
                 .groupBy("h1", "h2").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
                 .where("least <> most").select("h1", "h2"))
    return (lists.select("doc_id", "text_hash", F.explode("found").alias("c")).where("not c.first")
            .select("doc_id", "text_hash", "c.seq", "c.h1", "c.h2").join(differing, ["h1", "h2"], "left_anti")
            .groupBy("doc_id", "text_hash").agg(F.collect_set("seq").alias("chunks")))


def dedup_lines(docs: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``."""
    r = repeated_chunks(docs, max_lines)
    r = r.toDF(*[free_name(docs, stem=f"line_{c}") for c in r.columns])
    doc_id, text_hash, chunks = (r[c] for c in r.columns)
    joined = docs.join(r.hint("merge"), docs["doc_id"].eqNullSafe(doc_id) & (F.xxhash64(docs["text"]) == text_hash), "left")
    kept = _let(_lines(docs["text"]), lambda lines: F.array_join(F.transform(F.filter(
        pieces(lines, max_lines), lambda p, i: ~F.array_contains(chunks, i)), lambda p: _chunk_text(lines, p)), "\n"))
    text = F.when(chunks.isNull(), docs["text"]).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else of(docs, c) for c in docs.columns])
