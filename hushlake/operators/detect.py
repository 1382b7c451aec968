"""Detection of personal data in text."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import patterns as P
from .spans import SPAN, allow, resolve


def _at(text: Column, pattern: str, kind: str, prio: int, keep=None, value=None) -> Column:
    """Matches as spans; ``value`` may shorten a match from its ends."""
    found = checks.spans(text, pattern)
    if value is not None:
        def cut(s: Column) -> Column:
            v = value(s["value"])
            start = s["start"] + F.instr(s["value"], v) - 1
            return F.struct(start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), v.alias("value"))

        found = F.filter(F.transform(found, cut), lambda s: s["value"].isNotNull())
    if keep is not None:
        found = F.filter(found, lambda s: keep(s))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(prio).alias("prio")))


def emails(text: Column, prio: int = 0) -> Column:
    return _at(text, P.EMAIL, "EMAIL_ADDRESS", prio)


def cards(text: Column, prio: int = 2) -> Column:
    alone = lambda s: ~F.substr(text, s["start"], F.lit(1)).rlike("[0-9]") | (s["start"] == 0)
    return _at(text, P.CARD, "CREDIT_CARD", prio, lambda s: alone(s) & ~F.substr(text, s["end"] + 1, F.lit(1)).rlike("[0-9]") & checks.card_ok(s["value"]))


def phones(text: Column, prio: int = 3) -> Column:
    return _at(text, P.PHONE, "PHONE_NUMBER", prio, value=checks.phone_of)


def ipv4(text: Column, prio: int = 4) -> Column:
    return _at(text, P.IPV4, "IP_ADDRESS", prio)


def dates(text: Column, prio: int = 5) -> Column:
    return _at(text, P.DATE, "DATE_TIME", prio, lambda s: checks.date_ok(s["value"]))


def ibans(text: Column, prio: int = 1) -> Column:
    return _at(text, P.IBAN, "IBAN_CODE", prio, value=checks.iban_of)


NATIVE = {"email": emails, "iban": ibans, "credit_card": cards, "phone": phones, "ip_address": ipv4, "datetime": dates}


def scan_native(text: Column, recognizers: list[str] | None = None, kinds: list[str] | None = None) -> Column:
    """All built-in recognizers but IPv6 as built-in expressions: no Python on the way."""
    names = [r for r in P.RECOGNIZERS if recognizers is None or r in recognizers]
    found = F.concat(*[F.coalesce(NATIVE[r](text, i), F.array().cast(SPAN)) for i, r in enumerate(names)])
    return allow(resolve(found), kinds)


Recognizer = Callable[[str], Iterator[tuple[int, int, str]]]


@dataclass
class Engine:
    """What is looked for: custom recognizers by name and pattern, those switched off, kinds allowed, and a model for names.

    ``ner`` maps a text to spans (start, end, kind, score); those of ``threshold`` or more count.
    ``ner_roles`` limits it to texts of these roles, or of none; patterns always run. With
    ``fail_closed`` an error of the model ends the job, otherwise the text has no names.
    """

    custom: dict[str, str] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()
    kinds: tuple[str, ...] | None = None
    ner: Callable[[str], list[tuple[int, int, str, float]]] | None = None
    threshold: float = 0.5
    ner_roles: tuple[str, ...] | None = None
    fail_closed: bool = False

    def __post_init__(self) -> None:
        for name, pattern in self.custom.items():
            if not re.fullmatch(r"[A-Za-z0-9_]+", name) or not pattern:
                raise ValueError(f"custom recognizer {name!r}: a name of letters, digits and underscores and a pattern are needed")
            re.compile(pattern)
        if self.kinds is not None:
            known = set(P.PREFIX_OF) | set(self.custom)
            named = tuple(P.ALIASES.get(k.strip().upper(), k.strip().upper()) if k not in self.custom else k for k in self.kinds)
            if not named or set(named) - known:
                raise ValueError(f"unknown or no kinds: {sorted(set(named) - known)}")
            self.kinds = named

    def recognizers(self) -> list[Recognizer]:
        built_in = {"email": _emails, "iban": _ibans, "credit_card": _cards, "phone": _phones, "ip_address": _addresses, "datetime": _dates}
        own = [_custom(name, p) for name, p in self.custom.items()]
        return [built_in[r] for r in P.RECOGNIZERS if r not in self.disabled] + own

    def names(self, text: str, role: str | None) -> list[tuple[int, int, str]]:
        if self.ner is None or not (role is None or self.ner_roles is None or role.lower() in {r.lower() for r in self.ner_roles}):
            return []
        try:
            return [(s, e, k) for s, e, k, score in self.ner(text) if score >= self.threshold]
        except Exception:
            if self.fail_closed:
                raise
            return []

    def scan(self, text: str | None, role: str | None = None, found: list[Recognizer] | None = None) -> list[dict]:
        """Resolved spans of a text, of the allowed kinds."""
        every = [(s, -e, i, k) for i, f in enumerate(found or self.recognizers()) for s, e, k in f(text or "")]
        every += [(s, -e, len(P.RECOGNIZERS) + len(self.custom), k) for s, e, k in self.names(text or "", role)]
        out, end = [], 0
        for s, back, i, k in sorted(every):
            if s >= end:
                end = -back
                out.append({"start": s, "end": end, "kind": k, "prio": i})
        return [s for s in out if self.kinds is None or s["kind"] in self.kinds]


_EMAIL, _PHONE, _IBAN, _CARD, _V4, _V6, _DATE = map(re.compile, (P.EMAIL, P.PHONE, P.IBAN, P.CARD, P.IPV4, P.IPV6, P.DATE))


def _emails(t):
    return ((m.start(), m.end(), "EMAIL_ADDRESS") for m in _EMAIL.finditer(t))


def _phones(t):
    for m in _PHONE.finditer(t):
        v = m[0]
        if sum(c in "0123456789" for c in v) >= 7:
            start = m.start() + len(v) - len(v.lstrip(" "))
            yield start, m.start() + len(v.rstrip(" -/.(")), "PHONE_NUMBER"


def iban_valid(v: str) -> bool:
    v = v.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and v.isascii() and v.isalnum() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ibans(t):
    for m in _IBAN.finditer(t):
        v = m[0].rstrip(" ")
        while len(v) >= 15:
            if iban_valid(v):
                yield m.start(), m.start() + len(v), "IBAN_CODE"
                break
            v = v.rpartition(" ")[0].rstrip(" ")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _cards(t):
    digit = set("0123456789")
    for m in _CARD.finditer(t):
        a, b = m.span()
        d = "".join(c for c in m[0] if c in digit)
        if t[a - 1 : a] not in digit and t[b : b + 1] not in digit and 13 <= len(d) <= 19 and luhn(d):
            yield a, b, "CREDIT_CARD"


def _addresses(t):
    for m in _V4.finditer(t):
        yield m.start(), m.end(), "IP_ADDRESS"
    if ":" in t:
        for m in _V6.finditer(t):
            a, b = m.span()
            glued = lambda c: c.isalnum() or c == ":"
            if glued(t[a - 1 : a] or " ") or glued(t[b : b + 1] or " "):
                continue
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield a, b, "IP_ADDRESS"


def _dates(t):
    for m in _DATE.finditer(t):
        d, mo = (m[1], m[2]) if m[1] else (m[6], m[5])
        if 1 <= int(d) <= 31 and 1 <= int(mo) <= 12:
            yield m.start(), m.end(), "DATE_TIME"


def _custom(name: str, pattern: str) -> Recognizer:
    compiled = re.compile(pattern)
    return lambda t: ((m.start(), m.end(), name) for m in compiled.finditer(t))


def scan(docs: DataFrame, engine: Engine | None = None, text: str = "text", role: str | None = None) -> DataFrame:
    """``docs`` with spans: the whole engine on each text, in Arrow batches; a text crosses to Python once."""
    engine = engine or Engine()

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series, roles: pd.Series) -> pd.Series:
        found = engine.recognizers()
        return pd.Series([engine.scan(t, r, found) for t, r in zip(texts, roles)])

    return docs.withColumn("spans", run(F.col(text), F.col(role) if role else F.lit(None).cast("string")))


def scan_distinct(docs: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    """Like ``scan``, each different text once: for a costly model over many equal texts."""
    once = scan(docs.select(text).distinct(), engine, text)
    return docs.join(once.withColumnRenamed(text, "text_"), F.col(text).eqNullSafe(F.col("text_")), "left").drop("text_")


def values(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each span: the rows of ``docs``, n (its place), start, end, kind, prefix and value."""
    prefix = F.create_map(*[F.lit(x) for kv in P.PREFIX_OF.items() for x in kv])
    rows = docs.select("*", F.posexplode("spans").alias("n", "span"))
    value = F.substr(text, F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    return rows.select(*[c for c in docs.columns if c != "spans"], "n", "span.start", "span.end", "span.kind", F.coalesce(prefix[F.col("span.kind")], F.upper("span.kind")).alias("prefix"), value.alias("value"))
