"""Dates as text: the forms a column may have, and the election of one form a column.

A single value such as ``01/02/2024`` does not tell its form; a column does. Every value is
taken apart once and has at most two readings (month-first and day-first, or a short and a long month name), each
with the form it follows and the timestamp it gives. One aggregate counts for every form how many of the
column's values can be read by it, and the first form that fits all values is the column's: month-first comes
before day-first, as pandas reads text dates. (Pandas reads a column of two-digit years value by value and may mix
both orders; here such a column has one order as any other.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prism.functions.sqltext import q, slit

ISO = "iso"
# The forms in the order of their election. Month-first comes before day-first.
DATE_FORMS = [
    ISO, "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMMM-yyyy",
    "M/d/yy", "M-d-yy", "M.d.yy", "d/M/yy", "d-M-yy", "d.M.yy", "d MMM yy", "d MMMM yy", "d-MMM-yy", "d-MMMM-yy",
]
#: Text that stands for no date.
NO_DATE = ["", "NaT", "nat", "NAT", "nan", "NaN", "NAN"]
# English month names.
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
           "december"]
_ISO_SHAPE = (r"^\d{4}(?:-\d{1,2}(?:-\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?"
              r"(?: ?(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?))?)?)?)?$")
#: The parts of a date, by group: 1-4 numbers with a separator, 5-7 eight digits, 8-11 month name first,
#: 12-15 day before a month name; 16-19 the time of day.
_PARTS = (r"^(?:(\d{1,4})([/.\-])(\d{1,2})\2(\d{1,4})|(\d{4})(\d{2})(\d{2})|([A-Za-z]{3,9}) (\d{1,2})(,?) (\d{4})"
          r"|(\d{1,2})([ \-])([A-Za-z]{3,9})\13(\d{4}|\d{2}))"
          r"(?:[ T](\d{1,2}):([0-5]\d)(?::([0-5]\d(?:\.\d{1,9})?))?(?: ?([AaPp][Mm]))?)?$")
_MARK = "\x01"


def _number(group: int) -> str:
    return f"CAST(nullif(p[{group - 1}], '') AS INT)"


def _month(name: str) -> str:
    """Number of a month's English name, short or long; null for other words."""
    names = " ".join(f"WHEN lower({name}) IN ({slit(m[:3])}, {slit(m)}) THEN {i}" for i, m in enumerate(_MONTHS, 1))
    return f"CASE {names} END"


# What a value is made of, by the group that tells its kind, in steps that use the columns of the step before.
_KINDS = "CASE WHEN size(p) <> 19 THEN 'no' WHEN p[4] <> '' THEN 'digits' WHEN p[7] <> '' THEN 'name first' WHEN p[13] <> '' THEN 'day first' " \
         "WHEN length(p[0]) = 4 AND length(p[3]) <= 2 THEN 'year first' WHEN length(p[0]) <= 2 AND length(p[3]) IN (2, 4) THEN 'numbers' ELSE 'no' END"
_STEPS = [
    {"kind": _KINDS},
    {
        "name": "CASE kind WHEN 'name first' THEN p[7] WHEN 'day first' THEN p[13] END",
        "year": f"CASE kind WHEN 'digits' THEN {_number(5)} WHEN 'name first' THEN {_number(11)} WHEN 'day first' THEN {_number(15)} "
                f"WHEN 'year first' THEN {_number(1)} WHEN 'numbers' THEN {_number(4)} END",
        "day": f"CASE kind WHEN 'digits' THEN {_number(7)} WHEN 'name first' THEN {_number(9)} WHEN 'day first' THEN {_number(12)} "
               f"WHEN 'year first' THEN {_number(4)} WHEN 'numbers' THEN {_number(3)} END",
        "hour": f"IF(kind = 'no', NULL, coalesce({_number(16)}, 0))", "minute": f"IF(kind = 'no', NULL, coalesce({_number(17)}, 0))",
        "second": "IF(kind = 'no', NULL, coalesce(CAST(nullif(p[17], '') AS DECIMAL(16, 6)), 0))",
        "half": "IF(kind = 'no', NULL, lower(p[18]))",
        # the year's letters and what stands between the numbers
        "years": "IF(kind = 'numbers' AND length(p[3]) = 2 OR kind = 'day first' AND length(p[14]) = 2, 'yy', 'yyyy')",
        "mark": "CASE kind WHEN 'name first' THEN p[9] WHEN 'day first' THEN p[12] WHEN 'no' THEN '' ELSE p[1] END",
    },
    {
        "month": f"CASE WHEN name IS NOT NULL THEN {_month('name')} WHEN kind = 'digits' THEN {_number(6)} "
                 f"WHEN kind = 'year first' THEN {_number(3)} WHEN kind = 'numbers' THEN {_number(1)} END",
        "letters": "IF(length(name) = 3, 'MMM', 'MMMM')",
        # two digits mean the century that puts the year less than 50 years ahead
        "year": "IF(years = 'yyyy', year, IF(year + 2000 >= year(current_date()) + 50, year + 1900, year + 2000))",
        "hour": "CASE WHEN half = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + IF(half = 'pm', 12, 0) END",
    },
    {
        "f0": f"CASE WHEN raw RLIKE {slit(_ISO_SHAPE)} THEN {slit(ISO)} WHEN kind = 'digits' THEN 'yyyyMMdd' "
              "WHEN kind = 'year first' THEN 'yyyy' || mark || 'M' || mark || 'd' WHEN kind = 'numbers' THEN 'M' || mark || 'd' || mark || years "
              "WHEN kind = 'name first' THEN letters || ' d' || mark || ' yyyy' WHEN kind = 'day first' THEN 'd' || mark || letters || mark || years END",
        "f1": "CASE WHEN kind = 'numbers' THEN 'd' || mark || 'M' || mark || years "  # May is a short and a long name
              "WHEN lower(name) = 'may' THEN IF(kind = 'name first', 'MMMM d' || mark || ' yyyy', 'd' || mark || 'MMMM' || mark || years) END",
        "first": "CASE WHEN month BETWEEN 1 AND 12 AND day BETWEEN 1 AND 31 AND hour < 24 THEN try_make_timestamp(year, month, day, hour, minute, second) END",
        "swapped": "CASE WHEN kind = 'numbers' AND day BETWEEN 1 AND 12 AND month BETWEEN 1 AND 31 AND hour < 24 THEN "
                   "try_make_timestamp(year, day, month, hour, minute, second) END",
    },
    {"t0": f"IF(f0 = {slit(ISO)}, try_cast(raw AS TIMESTAMP), first)", "t1": "IF(kind = 'numbers', swapped, IF(f1 IS NULL, NULL, first))"},
]
_NAMES = sorted({"raw", "p"}.union(*_STEPS), key=len, reverse=True)


def _of(sql: str, text: str) -> str:
    """A step's SQL for the parts of that text column."""
    return re.sub(r"'[^']*'|\b(" + "|".join(_NAMES) + r")\b(?!\()", lambda m: f"{text}_{m[1]}" if m[1] else m[0], sql)


def forms_of(formats: list[str] | None) -> list[str]:
    """ISO and the caller's patterns, or all known forms."""
    return DATE_FORMS if formats is None else [ISO, *formats]


def date_text(name: str) -> Column:
    """The column's text where it stands for a date or should, else null."""
    text = F.col(q(name))
    return F.when(~text.isin(NO_DATE), F.trim(text))


def read_dates(df: DataFrame, texts: list[str], formats: list[str] | None = None) -> tuple[DataFrame, dict[str, list[tuple[str, str]]]]:
    """The frame with the readings of its text columns ``texts`` (simple names), and for each the names of
    (form, timestamp) columns. The timestamp is null where the text is no date of that form."""
    names = {t: [(f"{t}_f{k}", f"{t}_t{k}") for k in range(2 if formats is None else len(formats) + 1)] for t in texts}
    if formats is None:
        marked = _MARK.join(f"${g}" for g in range(1, 20))
        out = df.select("*", *[F.col(t).alias(f"{t}_raw") for t in texts],
                        *[F.split(F.regexp_replace(t, _PARTS, marked), _MARK, -1).alias(f"{t}_p") for t in texts])
        for step in _STEPS:
            made = {f"{t}_{n}": f"{_of(sql, t)} AS {t}_{n}" for t in texts for n, sql in step.items()}
            out = out.selectExpr(*[q(c) for c in out.columns if c not in made], *made.values())
        return out.select(*[q(c) for c in df.columns], *[c for pairs in names.values() for pair in pairs for c in pair]), names
    made = []
    for t in texts:
        tried = [F.when(F.col(t).rlike(_ISO_SHAPE), F.expr(f"try_cast({t} AS TIMESTAMP)")),
                 *[F.try_to_timestamp(t, F.lit(f)) for f in formats]]
        made += [c for (f, s), form, time in zip(names[t], forms_of(formats), tried) for c in (F.lit(form).alias(f), time.alias(s))]
    return df.select("*", *made), names


def by_form(readings: list[tuple[str, str]], form: str) -> str:
    """SQL of the timestamp by that form, else null."""
    return "CASE " + " ".join(f"WHEN {f} = {slit(form)} AND {t} IS NOT NULL THEN {t}" for f, t in readings) + " END"


def elected(values: str, fits: list[str], entries: list[str]) -> str:
    """SQL of the entry of the first form that fits all values; null where none does or there are no values."""
    return "CASE " + " ".join(f"WHEN {values} > 0 AND {n} = {values} THEN {e}" for n, e in zip(fits, entries)) + " END"
