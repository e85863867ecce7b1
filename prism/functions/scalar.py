"""Scalar functions (X1-X15), all native Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TITLE = "Nouvelle conversation"
ELLIPSIS = "…"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fn_percentage(part, total) -> Column:
    """round(part / total * 100, 2); 0 when total is 0 or an input is not numeric."""
    p, t = _c(part).try_cast("double"), _c(total).try_cast("double")
    return F.coalesce(F.round(F.try_divide(p, F.when(t != 0, t)) * 100, 2), F.lit(0.0))


def fn_multiply(a, b) -> Column:
    """Float product; when ``b`` is not numeric the first input is returned
    (as a double; a non-numeric first input gives NULL, a Column has one type)."""
    x, y = _c(a).try_cast("double"), _c(b).try_cast("double")
    return F.coalesce(x * y, x)


def fn_concat(a, b) -> Column:
    """Text concatenation of two values."""
    return F.concat(_c(a).cast("string"), _c(b).cast("string"))


def fn_map_get(m, key) -> Column:
    """Map lookup, absent -> NULL. JSON text is read with a JSON path."""
    return F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key))


def fn_json_get(doc, key: str) -> Column:
    """X4 over JSON text: ``$.key``."""
    return F.get_json_object(_c(doc), f"$.{key}")


def tags_split(c) -> Column:
    """``"a, b,,c"`` -> ["a", "b", "c"] (trimmed, empty parts dropped)."""
    return F.filter(F.transform(F.split(_c(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def tags_join(a) -> Column:
    """Array -> ``"a, b"``."""
    return F.array_join(_c(a), ", ")


def tags_overflow(a, k: int = 3) -> Column:
    """struct(first k tags, count of the rest)."""
    arr = _c(a)
    return F.struct(F.slice(arr, 1, k).alias("shown"), F.greatest(F.size(arr) - k, F.lit(0)).alias("rest"))


def fn_truncate(c, n: int) -> Column:
    """At most n characters, the last being an ellipsis when cut."""
    s = _c(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit(ELLIPSIS))).otherwise(s)


def title_from_message(title, text, n: int = 50, default: str = DEFAULT_TITLE) -> Column:
    """A session still carrying the default title takes the first n characters
    of its first user message, with ``...`` when longer."""
    t, m = _c(title), _c(text)
    derived = F.concat(F.substring(m, 1, n), F.when(F.length(m) > n, F.lit("...")).otherwise(F.lit("")))
    return F.when((t == default) & m.isNotNull(), derived).otherwise(t)


def default_title(title, dataset, default: str = DEFAULT_TITLE) -> Column:
    """Blank or default title -> ``Analyse de {dataset}``."""
    t = _c(title)
    return F.when(t.isNull() | (t == "") | (t == default),
                  F.concat(F.lit("Analyse de "), _c(dataset).cast("string"))).otherwise(t)


# Human file-size units (binary multiples) and the non-breaking space between number and unit.
SIZE_UNITS = ["KB", "MB", "GB", "TB", "PB"]
NBSP = "\u00a0"


def fn_human_bytes(n) -> Column:
    """X11: bytes -> ``"1 byte"``, ``"12 bytes"``, ``"1.5 KB"`` ... ``"PB"`` (one decimal)."""
    b = _c(n).cast("double")
    e = F.when(b == 1, F.lit(f"1{NBSP}byte")).when(
        b < 1024, F.concat(b.cast("bigint").cast("string"), F.lit(f"{NBSP}bytes")))
    for k, unit in enumerate(SIZE_UNITS, start=1):
        scaled = F.format_string("%.1f", F.bround(b / F.lit(float(1024 ** k)), 1))
        cond = b < F.lit(float(1024 ** (k + 1))) if unit != SIZE_UNITS[-1] else F.lit(True)
        e = e.when(cond, F.concat(scaled, F.lit(f"{NBSP}{unit}")))
    return e


def fn_default_dash(c, mark: str = "—") -> Column:
    """NULL -> a mark."""
    return F.coalesce(_c(c).cast("string"), F.lit(mark))


def fn_iso_timestamp(ts, fmt: str | None = None) -> Column:
    """Timestamp -> text. Default is ISO-8601 as Python's ``isoformat``
    (microseconds only when non-zero); ``fmt`` gives other forms such as
    ``HH:mm:ss`` or ``dd/MM/yyyy HH:mm``."""
    t = _c(ts)
    if fmt is not None:
        return F.date_format(t, fmt)
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_sql(expr: str) -> str:
    """SQL twin of the default :func:`fn_iso_timestamp`."""
    return (f"CASE WHEN strftime({expr}, '%f') = '000000' THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END")


def json_array_sizes(doc) -> Column:
    """struct(points = size of labels, series = size of datasets) of a chart document."""
    d = _c(doc)
    return F.struct(F.json_array_length(F.get_json_object(d, "$.labels")).alias("points"),
                    F.json_array_length(F.get_json_object(d, "$.datasets")).alias("series"))


def fn_json_pretty(doc, schema: str) -> Column:
    """JSON text normalised by a parse/serialise round trip under ``schema``."""
    return F.to_json(F.from_json(_c(doc), schema))
