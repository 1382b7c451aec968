"""Checksums and spans as built-in expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK_OPEN, MARK_CLOSE = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern as (start, end, value), in characters, end exclusive.

    Matches are marked in the text, which is then split at the marks, so no match is looked up again
    by its value. The two mark characters in the text itself count as spaces.
    """
    plain = F.translate(text, MARK_OPEN + MARK_CLOSE, "  ")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{MARK_OPEN}$1{MARK_CLOSE}"), f"[{MARK_OPEN}{MARK_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("got"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.length(part)
        one = F.array(F.struct(a["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["got"], one)).otherwise(a["got"]).alias("got"))

    return F.when(text.isNotNull(), F.aggregate(parts, start, step, lambda a: a["got"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def card_ok(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_ok(value: Column) -> Column:
    """15 to 34 letters and digits, spaces left out, that are 1 modulo 97 once the first four stand last and letters count from 10."""
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    moved = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))
    number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).when(c.rlike("[0-9]"), F.ascii(c) - 48))
    rest = F.aggregate(F.filter(number, lambda x: x.isNotNull()), F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97)
    return F.length(v).between(15, 34) & v.rlike("^[A-Z0-9]+$") & (rest == 1)


def iban_of(candidate: Column) -> Column:
    """The longest beginning of whole words of a candidate that is an IBAN; null if none of 15 characters or more is."""
    words = F.split(F.rtrim(candidate), " ")
    tries = F.transform(F.reverse(F.sequence(F.lit(1), F.size(words))), lambda n: F.rtrim(F.array_join(F.slice(words, 1, n), " ")))
    return F.get(F.filter(tries, lambda t: (F.length(t) >= 15) & iban_ok(t)), F.lit(0))


def phone_of(value: Column) -> Column:
    """A phone match without loose ends; null if it has fewer than seven digits."""
    return F.when(F.length(digits(value)) >= 7, F.regexp_replace(F.regexp_replace(value, r"[ \-/.(]+$", ""), r"^ +", ""))


def date_ok(value: Column) -> Column:
    """Day 1 to 31 and month 1 to 12; nothing else is looked at."""
    dotted = value.contains(".")
    part = lambda a, b: F.when(dotted, F.split_part(value, F.lit("."), F.lit(a))).otherwise(F.split_part(value, F.lit("-"), F.lit(b))).cast("int")
    return part(1, 3).between(1, 31) & part(2, 2).between(1, 12)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, of a binary column, from two hashes; the padded keys are literals."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))), 256)


def subkey(master: bytes, label: str) -> bytes:
    return hmac.new(master, label.encode(), hashlib.sha256).digest()
