"""URL filters: rules first, then a character language-model ratio.

A rule fits its host and all subdomains where the path starts with the rule's path; the
longest fitting rule decides. URLs under a rule are also the examples: two smoothed
variable-order Markov models over characters, one of the allowed and one of the blocked
URLs, give every other URL a log-likelihood difference per character. Each order backs
off to the next shorter context by Witten-Bell weights, down to a uniform distribution.
The threshold is calibrated on a fold of the ruled URLs that the models do not count: the edge
(in steps of 1/64) with the greatest balanced accuracy, among equals the one nearest zero.

Everything is counts, joins and one fold over at most ``ORDER + 1`` rows a window, so only
DataFrame functions are used. Windows are counted before they are expanded to the shorter
contexts, and each distinct window is scored once.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule; its
whole text (null: none) is scored; a text without characters has difference 0; without
examples of one kind in the fold the threshold is 0, without any examples every difference is 0 and the
verdict allow; equal URLs get equal verdicts; no rows give no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.llm.common import ascii_lower, free_name, of
from prism.session import cut_lineage

#: The rules (verdict, rule); a rule is a host with a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Characters of the longest context.
ORDER = 4
PAD = "\u0002"
UNIFORM = 1.0 / 256
STEPS = 64


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # longer rules come in front of shorter ones
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _windows(text: Column, order: int) -> Column:
    """The padded text's windows of ``order`` + 1 characters, one for each character."""
    chars = F.filter(F.split(F.concat(F.lit(PAD * order), text), ""), lambda c: c != "")
    slices = F.transform(F.array(chars), lambda cs: F.when(F.size(cs) > order, F.transform(
        F.sequence(F.lit(1), F.size(cs) - order), lambda i: F.array_join(F.slice(cs, i, order + 1), ""))))
    return F.coalesce(F.element_at(slices, 1), F.array().cast("array<string>"))


def _suffixes(order: int) -> Column:
    """The window's grams, from the last character to the whole window, each with its context."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.substring("window", order + 1 - k, k + 1).alias("gram"),
                              F.substring("window", order + 1 - k, k).alias("context")) for k in range(order + 1)])


def window_ratios(examples: DataFrame, windows: DataFrame, order: int = ORDER) -> DataFrame:
    """Examples (text, allowed, rows: how often) and windows (window) -> window, ratio: the difference of the log
    probabilities of the last character after the others under the two models."""
    rows = F.col("rows")
    counted = (examples.select(F.explode(_windows(F.col("text"), order)).alias("window"), "allowed", "rows")
               .groupBy("window").agg(F.sum(F.when(F.col("allowed"), rows).otherwise(0)).alias("a"),
                                      F.sum(F.when(F.col("allowed"), 0).otherwise(rows)).alias("b")))
    grams = cut_lineage(counted.select(F.explode(_suffixes(order)).alias("s"), "a", "b")
                        .groupBy("s.k", "s.gram", "s.context").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-grams")
    contexts = grams.groupBy("k", "context").agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"),
        F.count_if(F.col("b") > 0).alias("tb"))
    asked = windows.select("window", F.explode(_suffixes(order)).alias("s")).select("window", "s.k", "s.gram", "s.context")
    numbers = ("a", "b", "na", "nb", "ta", "tb")
    found = (asked.join(grams.drop("context"), ["k", "gram"], "left").join(contexts, ["k", "context"], "left")
             .select("window", F.struct("k", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in numbers]).alias("s"))
             .groupBy("window").agg(F.sort_array(F.collect_list("s")).alias("orders")))

    def longer(p: Column, seen: Column, total: Column, kinds: Column) -> Column:
        return F.when(total > 0, (seen + kinds * p) / (total + kinds)).otherwise(p)

    start = F.struct(F.lit(UNIFORM).alias("pa"), F.lit(UNIFORM).alias("pb"))
    p = F.aggregate("orders", start, lambda p, s: F.struct(
        longer(p["pa"], s["a"], s["na"], s["ta"]).alias("pa"), longer(p["pb"], s["b"], s["nb"], s["tb"]).alias("pb")))
    return found.select("window", p.alias("p")).select("window", (F.log("p.pa") - F.log("p.pb")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Scored examples (ratio, allowed, rows) -> the edge with the greatest balanced accuracy."""
    rows = (scored.groupBy(F.greatest(F.least(F.floor(F.col("ratio") * STEPS), F.lit(64 * STEPS)), F.lit(-64 * STEPS)).alias("step"))
            .agg(F.sum(F.when(F.col("allowed"), F.col("rows")).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("allowed"), 0).otherwise(F.col("rows"))).alias("b")).orderBy("step").collect())
    allowed, blocked = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not allowed or not blocked:
        return 0.0
    below_a = below_b = 0
    best, edge, least = -1.0, 0.0, -64 * STEPS
    for r in [*rows, None]:  # any edge above the step before and up to this one parts the examples alike
        most = r["step"] if r else 65 * STEPS
        worth = round((allowed - below_a) / allowed + below_b / blocked, 12)
        nearest = min(max(0, least), most) / STEPS
        if worth > best or worth == best and abs(nearest) < abs(edge):
            best, edge = worth, nearest
        if r:
            below_a, below_b, least = below_a + r["a"], below_b + r["b"], r["step"] + 1
    return edge


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """``pages`` (url and other columns) with host, path, rule, verdict and ratio; columns of
    these names that ``pages`` has itself are replaced."""
    url = F.col("url")
    text = F.coalesce(ascii_lower(F.coalesce(_after_scheme(url), url)), F.lit(""))
    rule = rule_of(host_of(url), path_of(url), rules)
    key = (F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    texts = cut_lineage(pages.select(text.alias("text"), rule["verdict"].alias("by_rule"), *[k.alias(n) for k, n in zip(key, "hi")])
                        .groupBy("text", "by_rule", "h", "i").agg(F.count(F.lit(1)).alias("rows")), "url-texts")
    fold = F.substring(F.md5("text"), 1, 1).isin("0", "1", "2")
    ruled = texts.where("by_rule is not null").select("text", (F.col("by_rule") == "allow").alias("allowed"), "rows", "h", "i", fold.alias("fold"))
    windows = texts.select("h", "i", F.explode(_windows(F.col("text"), order)).alias("window"))
    ratios = window_ratios(ruled.where("not fold"), windows.select("window").distinct(), order)
    scored = cut_lineage(windows.join(ratios, "window").groupBy("h", "i").agg(F.round(F.avg("ratio"), 9).alias("ratio")), "url-ratios")
    edge = _threshold(ruled.where("fold").join(scored, ["h", "i"]).select("ratio", "allowed", "rows"))
    names = {n: free_name(pages, stem=f"url_{n}") for n in ("h", "i", "ratio")}
    s = scored.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = pages.join(s, (key[0] == s[names["h"]]) & (key[1] == s[names["i"]]), "left")
    ratio = F.coalesce(s[names["ratio"]], F.lit(0.0))
    new = {"host": host_of(url), "path": path_of(url), "rule": rule["rule"],
           "verdict": F.coalesce(rule["verdict"], F.when(ratio >= edge, "allow").otherwise("block")), "ratio": ratio}
    kept = [of(pages, c) for c in pages.columns if c.lower() not in new]
    return joined.select(*kept, *[c.alias(n) for n, c in new.items()])
