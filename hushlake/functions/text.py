"""Scalar helpers for reports and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import META_KEY_CHARS, META_KEYS, META_VALUE_CHARS


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def latency(ms: Column) -> Column:
    """1.2s from a second up, else whole milliseconds."""
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / F.lit(1000.0))).otherwise(F.format_string("%dms", F.round(ms).cast("long")))


def cost(usd: Column) -> Column:
    """Dollars with two decimals, four under a cent."""
    return F.when((usd > 0) & (usd < 0.01), F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", usd))


def stamp(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def status_kind(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.between(300, 399), "warn").otherwise("down")


def mask_secret(value: Column) -> Column:
    """The first three and last four characters; values that name an environment variable stay."""
    long = F.concat(F.substr(value, F.lit(1), F.lit(3)), F.lit("…"), F.right(value, F.lit(4)))
    return F.when(value.contains("${"), value).when(F.length(value) <= 4, "••••").otherwise(long)


def mask_url(value: Column) -> Column:
    """A URL without its password."""
    return F.when(value.contains("${"), value).otherwise(F.regexp_replace(value, r"^([^@]*?://[^@:]*):[^@]*@", "$1:••••@"))


def truncate(value: Column, n: int) -> Column:
    return F.substr(value, F.lit(1), F.lit(n))


def json_escape(value: Column) -> Column:
    """The inside of a JSON string: quote, backslash and control characters escaped, others as \\u00XX in capitals."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for c in map(chr, range(32)):
        out = F.replace(out, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04X}")))
    return out


def metadata(body: Column, headers: Column) -> Column:
    """Metadata of a request: the body's, overridden by the headers'; nulls and long keys left out, values cut, the first keys in order."""
    both = F.map_concat(F.coalesce(F.map_filter(body, lambda k, v: ~F.map_contains_key(headers, k)), body), headers)
    fit = F.map_filter(both, lambda k, v: v.isNotNull() & (F.length(k) <= META_KEY_CHARS))
    keys = F.slice(F.array_sort(F.map_keys(fit)), 1, META_KEYS)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: truncate(fit[k], META_VALUE_CHARS)))
