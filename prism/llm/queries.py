"""The registered queries of the training-data operators and their DuckDB twins.

Each query applies one operator, with production parameters, to its whole table and
derives the digest columns from the operator's real output. Operators that SQL cannot
express have no twin; ``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.llm import (
    ann,
    bpe,
    chat,
    codes,
    decontaminate,
    licenses,
    linededup,
    mixing,
    perplexity,
    simhash,
    toxicity,
    urlfilter,
    whiten,
)
from prism.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@register("op8_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('8|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM per),
fill AS (
  SELECT *, cap / weight AS full_at,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, weight * (
           SELECT min_by(level, full_at) FROM fill WHERE level <= full_at)) AS target FROM fill),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM r""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def _control_sql(text: str) -> str:
    """DuckDB expression of the escaped text."""
    return (
        r"replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(" + text + r", '\', '\\')"
        r", '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), '<|endoftext|>', '<\|endoftext|>')"
        r", '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
        r", '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')"
    )


@register("op9_chat_format", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length({_control_sql("role")}) + (length(role) - length(replace(role, chr(10), ''))) + 1
           + length({_control_sql("text")}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # fixed values: the planted conversation whose texts are another template's control strings
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_paths(chat.reply_chain(conversations.unionByName(planted)))
    read = out.select(
        F.col("conv").alias("conv_id"), chat.parse(F.col("formatted")).alias("turns"),
        chat.unescape(F.array_join(F.filter("segments", lambda s: s["loss"])["text"], "")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.scorer(model)(F.col("text")).alias("toxicity"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.size("toxicity.spans").alias("n_spans"))


@register("op2_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
a AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
r AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 1000003 + h) % 2147483647 AS r FROM a),
b AS (
  SELECT *, CASE WHEN i BETWEEN 1 AND n - 2 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i)
                      AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS ends FROM r),
s AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS part FROM b),
p AS (SELECT *, (i - min(i) OVER (PARTITION BY doc_id, part)) // 32 AS piece FROM s),
c AS (
  SELECT doc_id, part, piece, min(i) AS i, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM p GROUP BY doc_id, part, piece),
k AS (
  SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY (n_lines >= 2), chunk ORDER BY doc_id, i) > 1 AS gone FROM c)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines,
       coalesce(length(string_agg(chunk, chr(10) ORDER BY i) FILTER (WHERE NOT gone)), 0)::BIGINT AS n_chars_kept,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", F.size(F.split("before", "\n")).cast("long").alias("n_lines"),
                      F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


@register("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, ids and the bytes they decode to, by the public byte-level vocabulary."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)


def token_digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(tokens(table(spark, sf_dir, "documents")))


@register("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", *perplexity.BASE_FIELDS, "base_failed", "kept", "perplexity")


@register("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.scanner()(F.col("text")).alias("scan"))
    base = F.filter("scan.matches", lambda m: m["kind"] == "base")
    first = F.transform(base, lambda m: m["first"])
    return found.select(
        "doc_id", "scan.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"]))), ",").alias("base_labels"),
        F.array_join(licenses.labels(F.col("scan")), ",").alias("labels"), licenses.score(F.col("scan")).alias("score"))


@register("op1_inverted_multi_index")
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits_sql(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _order_sql(k: int) -> str:
    """The step that takes the models from contexts of k - 1 characters to those of k."""
    def longer(kind: str) -> str:
        n, t = f"coalesce(c.n{kind}, 0)", f"coalesce(c.t{kind}, 0)"
        return f"CASE WHEN {n} > 0 THEN (coalesce(g.{kind}, 0) + {t} * s.p{kind}) / ({n} + {t}) ELSE s.p{kind} END::DOUBLE AS p{kind}"
    return (f"s{k} AS (SELECT s.w, {longer('a')}, {longer('b')} FROM s{k - 1} s "
            f"LEFT JOIN g ON g.k = {k - 1} AND g.gram = substr(s.w, {6 - k}, {k}) "
            f"LEFT JOIN c ON c.k = {k - 1} AND c.context = substr(s.w, {6 - k}, {k - 1}))")


@register("op3_url_filter", f"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, {_LOWER.format("coalesce(rest, url, '')")} AS text FROM p),
r AS (
  SELECT *, CASE WHEN {_fits_sql("example.org", "/en/1")} THEN 'example.org/en/1' WHEN {_fits_sql("example.org", "/es/")} THEN 'example.org/es/'
                 WHEN {_fits_sql("com", "/fr/")} THEN 'com/fr/' WHEN {_fits_sql("com", "/de/")} THEN 'com/de/'
                 WHEN {_fits_sql("org", "/")} THEN 'org/' END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM r),
t AS (SELECT text, by_rule, substr(md5(text), 1, 1) IN ('0', '1', '2') AS fold, count(*) AS n FROM v GROUP BY ALL),
x AS (SELECT *, substr(repeat(chr(2), 4) || text, i + 1, 5) AS w FROM (SELECT *, unnest(range(length(text))) AS i FROM t)),
w AS (
  SELECT w, coalesce(sum(n) FILTER (WHERE by_rule = 'allow'), 0) AS a, coalesce(sum(n) FILTER (WHERE by_rule = 'block'), 0) AS b
  FROM x WHERE by_rule IS NOT NULL AND NOT fold GROUP BY w),
g AS (
  SELECT k, substr(w, 5 - k::INT, k::INT + 1) AS gram, substr(w, 5 - k::INT, k::INT) AS context, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b
  FROM w, range(5) AS o(k) GROUP BY ALL),
c AS (SELECT k, context, sum(a) AS na, sum(b) AS nb, count_if(a > 0)::DOUBLE AS ta, count_if(b > 0)::DOUBLE AS tb FROM g GROUP BY ALL),
s0 AS (SELECT DISTINCT w, 1.0::DOUBLE / 256 AS pa, 1.0::DOUBLE / 256 AS pb FROM x),
{", ".join(_order_sql(k) for k in range(1, 6))},
m AS (SELECT text, round(avg(ln(pa) - ln(pb)), 9) AS ratio FROM x JOIN s5 USING (w) GROUP BY text),
h AS (
  SELECT greatest(least(floor(ratio * 64), 4096), -4096)::BIGINT AS step, coalesce(sum(n) FILTER (WHERE by_rule = 'allow'), 0) AS a,
         coalesce(sum(n) FILTER (WHERE by_rule = 'block'), 0) AS b FROM t JOIN m USING (text) WHERE by_rule IS NOT NULL AND fold GROUP BY ALL),
e AS (
  SELECT step AS most, coalesce(lag(step) OVER (ORDER BY step) + 1, -4096) AS least,
         coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_a,
         coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_b FROM h
  UNION ALL SELECT 4160, max(step) + 1, sum(a), sum(b) FROM h),
f AS (
  SELECT least(greatest(0, least), most) / 64.0 AS edge, most,
         round((s.a - below_a) / s.a + below_b / s.b, 12) AS worth FROM e, (SELECT sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM h) s WHERE s.a > 0 AND s.b > 0),
d AS (SELECT coalesce((SELECT edge FROM f ORDER BY worth DESC, abs(edge), most LIMIT 1), 0) AS edge)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(ratio, 0) >= edge THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN m USING (text), d""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op11_decontaminate", f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
x AS (
  SELECT row, n, k, list_slice(w, k, k + n - 1) AS gram
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT x.row, x.k, x.n, g.item_id FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
hit AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(k, k + n)) AS place FROM h) GROUP BY row),
item AS (
  SELECT row, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN item USING (row)""")
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, items)
    hit, items = decontaminate.hit_words(F.col("leak")), F.col("leak.items")
    return found.select("doc_id", "leak.n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _assign_sql(n: int) -> str:
    """Assignment to the codebooks b{n}: index and squared distance of each part's nearest entry."""
    return (f"a{n} AS (SELECT p.row, p.part, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, b.x), "
            f"lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.entry) AS best FROM p JOIN b{n} b USING (part) GROUP BY p.row, p.part)")


def _refine_sql(n: int) -> str:
    """The codebooks b{n + 1}: floored means of the parts that a{n} gives to each entry."""
    return (f"s{n} AS (SELECT part, best % 64 AS entry, place, sum(x[place])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 5) o(place) GROUP BY ALL), "
            f"m{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM s{n} GROUP BY part, entry), "
            f"b{n + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (part, entry))")


@register("op12_vector_codes", f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT row, part, list_slice(x, part * 4 + 1, part * 4 + 4) AS x FROM v, range(16) o(part)),
b0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= 64),
{_assign_sql(0)}, {_refine_sql(0)}, {_assign_sql(1)}, {_refine_sql(1)}, {_assign_sql(2)},
c AS (
  SELECT row, string_agg(lower(format('{{:02x}}', best % 64)), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM v JOIN c USING (row)""")
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", codes.hex_code(F.col("code")).alias("code"), "error", "label_error",
                        F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = whiten.prepared(table(spark, sf_dir, "embeddings"))
    model, distinct = whiten.fit(points)
    if model is None or not model.values:  # no spread, no components
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return points.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    error, n = whiten.identity_error(model, distinct), len(model.values)
    rows = whiten.whiten(points, model).select(
        "vec_id", "deviation", "whitened", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("component"))
    explained = F.array(*[F.lit(v / model.trace) for v in model.values])
    return rows.select("vec_id", "component", F.lit(model.centre.n).cast("long").alias("n"), "deviation",
                       F.get("whitened", F.col("component") - 1).alias("whitened"),
                       F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
