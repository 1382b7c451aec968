"""Guardrails: rules over texts, in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.patterns import CONTACT_KINDS, INJECTION
from .spans import merge

NONE = "array<struct<start:int,end:int>>"


@dataclass
class Rule:
    """kind: prompt_injection, banned_content or contact_info; phase: pre, post or both; action: block, flag or redact."""

    name: str
    kind: str
    action: str = "block"
    phase: str = "pre"
    patterns: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=lambda: list(CONTACT_KINDS))

    def __post_init__(self) -> None:
        if self.kind == "banned_content" and not self.patterns:
            raise ValueError(f"rule {self.name}: patterns are needed")
        if self.action not in ("block", "flag", "redact") or self.phase not in ("pre", "post", "both"):
            raise ValueError(f"rule {self.name}: unknown action or phase")

    def all_patterns(self) -> list[str]:
        return (INJECTION if self.kind == "prompt_injection" else []) + self.patterns

    def hit(self, text: Column, spans: Column) -> Column:
        if self.kind == "contact_info":
            return F.exists(spans, lambda s: s["kind"].isin(self.kinds))
        out = F.lit(False)
        for p in self.all_patterns():
            out = out | text.rlike(p)
        return F.coalesce(out, F.lit(False))

    def count(self, text: Column, spans: Column) -> Column:
        """How many spans match; those of several patterns count apart."""
        if self.kind == "contact_info":
            return F.size(F.filter(spans, lambda s: s["kind"].isin(self.kinds)))
        out = F.lit(0)
        for p in self.all_patterns():
            out = out + F.regexp_count(text, F.lit(p))
        return F.coalesce(out, F.lit(0))

    def find(self, text: Column, spans: Column) -> Column:
        if self.kind == "contact_info":
            return F.transform(F.filter(spans, lambda s: s["kind"].isin(self.kinds)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        found = [F.coalesce(F.transform(checks.spans(text, p), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(NONE)) for p in self.all_patterns()]
        return F.concat(*found)


def evaluate(text: Column, spans: Column, rules: list[Rule], phase: str) -> Column:
    """(outcome, rule, flags, redact, reason): the first matching rule that blocks; else the merged spans of those that redact; else the messages of those that flag; else allow."""
    own = [r for r in rules if r.phase in (phase, "both")]
    empty = F.array().cast(NONE)
    blocked = F.coalesce(*[F.when(r.hit(text, spans), F.lit(r.name)) for r in own if r.action == "block"], F.lit(None).cast("string"))
    redact = [r for r in own if r.action == "redact"]
    cuts = merge(F.concat(*[r.find(text, spans) for r in redact])) if redact else empty
    told = lambda r: F.concat(F.lit(f"guardrail `{r.name}` matched ("), r.count(text, spans), F.lit(" span(s))"))
    flags = [F.when(r.count(text, spans) > 0, told(r)) for r in own if r.action == "flag"]
    flagged = F.array_join(F.filter(F.array(*flags), lambda f: f.isNotNull()), "; ") if flags else F.lit("")
    outcome = F.when(blocked.isNotNull(), "block").when(F.size(cuts) > 0, "redact").when(flagged != "", "flag").otherwise("allow")
    return F.struct(
        outcome.alias("outcome"),
        blocked.alias("rule"),
        F.when(outcome == "flag", flagged).alias("flags"),
        F.when(outcome == "redact", cuts).otherwise(empty).alias("redact"),
        F.when(outcome == "block", F.concat(F.lit("guardrail `"), blocked, F.lit("` blocked content"))).when(outcome == "flag", flagged).alias("reason"),
    )


def enforce(requests: DataFrame, rules: list[Rule], phase: str, text: str = "text", spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """(passed, refused): ``requests`` with outcome and reason, those that a rule blocks apart; others pass, flagged or with spans to redact, and so do those without text."""
    judged = requests.withColumn("o_", evaluate(F.col(text), F.col(spans), rules, phase))
    told = judged.withColumns({"outcome": F.col("o_.outcome"), "reason": F.col("o_.reason"), "redact": F.col("o_.redact")}).drop("o_")
    return told.where("outcome <> 'block'"), told.where("outcome = 'block'").drop("redact")
