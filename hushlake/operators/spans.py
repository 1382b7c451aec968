"""Spans as arrays of structs: overlaps, merging, rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,prio:int>>"


def resolve(found: Column) -> Column:
    """Disjoint spans: of all in order of start, longer first, then priority, each that starts at or after the end of the last one kept.

    An earlier span is kept even if a longer one starts within it.
    """
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["prio"].alias("prio"), s["kind"].alias("kind")))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("kept"))

    def step(a: Column, s: Column) -> Column:
        one = F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"), s["prio"].alias("prio")))
        return F.when(s["start"] >= a["end"], F.struct((-s["back"]).alias("end"), F.concat(a["kept"], one).alias("kept"))).otherwise(a)

    return F.aggregate(F.array_sort(keyed), zero, step, lambda a: a["kept"])


def allow(spans: Column, kinds: list[str] | None) -> Column:
    """Spans of the allowed kinds. It comes after ``resolve``, so a span that isn't allowed can hide one that is."""
    return spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))


def merge(spans: Column) -> Column:
    """(start, end) spans in order, each once, those that overlap as one; spans that only touch stay apart."""
    plain = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]), joined).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(plain, zero, lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))


def widen(text: Column, spans: Column) -> Column:
    """Sorted, disjoint spans, each with the digits and underscores right behind it, up to the next span: a placeholder that those follow could not be told from a longer one."""
    ends = lambda s, i: F.coalesce(F.get(spans, i + 1)["start"], F.length(text)) - s["end"]
    more = lambda s, i: F.length(F.regexp_extract(F.substr(text, s["end"] + 1, ends(s, i)), "^[0-9_]*", 0))
    return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["end"] + more(s, i)).cast("int").alias("end"), s["kind"].alias("kind"), s["prio"].alias("prio")))


def rewrite(text: Column, spans: Column) -> Column:
    """The text with each of the sorted, disjoint spans (start, end, token) replaced by its token."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["token"]).alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def byte_offsets(text: Column, span: Column) -> Column:
    """A span's offsets in bytes of UTF-8."""
    bytes_to = lambda n: F.octet_length(F.substr(text, F.lit(1), n))
    return F.struct(bytes_to(span["start"]).alias("start"), bytes_to(span["end"]).alias("end"))
