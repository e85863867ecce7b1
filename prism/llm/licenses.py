"""License scans: identifier tags, notice phrases and license expressions.

One Aho-Corasick automaton a task finds all phrases in the words of a text (joined by single
spaces, so a match is a match of whole words). Where the tag of an SPDX identifier is
found, the rest of its line is read as a license expression: a shunting-yard parser puts
AND, OR and WITH (binding in the reverse of that order) and parentheses into postfix
form, which is evaluated to the license families named and to whether the terms are permissive
(AND: both sides, OR: either side, WITH: the license's own).

An expression ends at the first token that cannot follow; without a complete one the
tag counts as a bare mention.

Defined cases: null text is empty; without words there are no matches and the score is 0;
texts of any length are read whole; repeated rows come out alike; other columns are ignored
by the Column form :func:`scanner`, which adds one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notice phrases of the method and their labels, in words without punctuation.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under apache 2 0": "apache",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "licensed under cc0": "cc",
    "isc license": "isc",
    "boost software license": "boost",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Families by the start of an SPDX identifier, longest first, and whether they are permissive.
FAMILIES = {
    "agpl": False, "apache": True, "bsd": True, "0bsd": True, "bsl": True, "cc0": True, "cc": False, "epl": False,
    "gpl": False, "isc": True, "lgpl": False, "mit": True, "mpl": False, "unlicense": True, "zlib": True,
}
#: How sure one piece of evidence makes the scan.
SURE = {"tag": 0.95, "notice": 0.8, "base": 0.6, "mention": 0.3}
TAG_LINE = re.compile(r"spdx-license-identifier\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:\-]+)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: A-Z to lower case; other ASCII characters that are no digit or letter to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Terms:
    families: frozenset
    permissive: bool


def postfix(text: str) -> tuple[list[str], str] | None:
    """The longest license expression that ``text`` starts with, in postfix form, and its text; else None."""
    def close(output: list, stack: list) -> list[str]:
        return output + stack[::-1]

    output, stack, depth, operand, at, whole = [], [], 0, True, 0, None
    while m := TOKEN.match(text, at):
        token, at = m[1], m.end()
        word = token.lower()
        if operand:  # a license or an opening parenthesis may come here
            if token == "(":
                stack.append(token)
                depth += 1
                continue
            if token == ")" or word in PRECEDENCE:
                break
            output.append(token)
            operand = False
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand = True
            continue
        else:
            break
        if not depth:
            whole = close(output, stack), text[:at].strip()
    return whole


def terms_of(identifier: str) -> Terms:
    name = identifier.lower()
    family = next((f for f in sorted(FAMILIES, key=len, reverse=True) if name.startswith(f)), None)
    return Terms(frozenset([{"0bsd": "bsd", "bsl": "boost", "cc0": "cc"}.get(family, family) or "other"]), FAMILIES.get(family, False))


def evaluate(tokens: list[str]) -> Terms:
    """The families and permissiveness of a postfix expression."""
    stack: list[Terms | str] = []
    for token in tokens:
        if token not in PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        left = terms_of(left) if isinstance(left, str) else left
        if token == "with":  # the exception's name is no license
            stack.append(left)
            continue
        right = terms_of(right) if isinstance(right, str) else right
        both = left.permissive and right.permissive if token == "and" else left.permissive or right.permissive
        stack.append(Terms(left.families | right.families, both))
    return terms_of(stack[0]) if isinstance(stack[0], str) else stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_phrase: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("mention", {TAG: "spdx"})):
        for phrase, label in phrases.items():
            by_phrase.setdefault(phrase, []).append((kind, label))
    for phrase, uses in by_phrase.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, uses))
    found.make_automaton()
    return found


def scan_text(text: str, matcher: ahocorasick.Automaton) -> dict:
    """n_words, matches (first word, words, kind, label) by place, and expressions (text, families, permissive)."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    matches, tagged, at, index = [], False, 0, 0
    hits = sorted((end - length + 1, n, uses) for end, (length, n, uses) in matcher.iter(line))
    for start, n, uses in hits:
        index, at = index + line.count(" ", at, start), start
        for kind, label in uses:
            tagged = tagged or kind == "mention"
            matches.append({"first": index, "n": n, "kind": kind, "label": label})
    expressions = []
    for m in TAG_LINE.finditer(text) if tagged else ():
        if parsed := postfix(m[1]):
            terms = evaluate(parsed[0])
            expressions.append({"expression": parsed[1], "families": sorted(terms.families), "permissive": terms.permissive})
    return {"n_words": len(words), "matches": matches, "expressions": expressions}


SCAN = ("n_words long, matches array<struct<first: long, n: int, kind: string, label: string>>, "
        "expressions array<struct<expression: string, families: array<string>, permissive: boolean>>")
_MATCHES = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("label", pa.string())]))
_EXPRESSIONS = pa.list_(pa.struct([("expression", pa.string()), ("families", pa.list_(pa.string())), ("permissive", pa.bool_())]))


def scanner():
    """Arrow UDF: text -> struct(n_words, matches, expressions)."""
    @F.arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = automaton()
        for texts in batches:
            yield pa.array([scan_text(t.as_py() or "", matcher) for t in texts],
                           pa.struct([("n_words", pa.int64()), ("matches", _MATCHES), ("expressions", _EXPRESSIONS)]))

    return scan


def score(scan):
    """0 to 1 from a scan: how sure its kinds of evidence make it, each kind of evidence for a label once."""
    pieces = F.array_distinct(F.transform(scan["matches"], lambda m: F.struct(m["kind"].alias("kind"), m["label"].alias("label"))))
    doubt = F.aggregate(pieces, F.lit(1.0), lambda d, p: d * (1 - F.when(p["kind"] == "base", SURE["base"])
                                                             .when(p["kind"] == "notice", SURE["notice"]).otherwise(SURE["mention"])))
    return 1 - doubt * F.when(F.size(scan["expressions"]) > 0, 1 - SURE["tag"]).otherwise(1.0)


def labels(scan):
    """All labels found: of base phrases, notices and expressions, distinct and sorted."""
    named = F.transform(F.filter(scan["matches"], lambda m: m["kind"] != "mention"), lambda m: m["label"])
    return F.array_sort(F.array_distinct(F.concat(named, F.flatten(F.transform(scan["expressions"], lambda e: e["families"])))))
