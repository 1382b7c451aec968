"""Configuration: TOML with environment variables, checked before any job."""

from __future__ import annotations

import math
import os
import re
import tomllib
from dataclasses import dataclass, field

from ..functions.patterns import ALIASES, PREFIX_OF
from ..operators.detect import Engine
from ..operators.guard import Rule

KNOWN = {"pii", "guardrails", "prices", "aliases", "connections", "keys"}


def expand(value, env: dict[str, str] | None = None):
    """``${NAME}`` in strings by the environment; an unknown name is an error, an unclosed ``${`` stays."""
    env = os.environ if env is None else env

    def one(m: re.Match) -> str:
        if m[1] not in env:
            raise ValueError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    if isinstance(value, str):
        return re.sub(r"\$\{([^}]*)\}", one, value)
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return value


def kind(name: str) -> str:
    """A kind's canonical name: case and space around don't count."""
    plain = name.strip().upper()
    return ALIASES.get(plain, plain)


@dataclass
class Config:
    engine: Engine = field(default_factory=Engine)
    rules: list[Rule] = field(default_factory=list)
    prices: list[tuple[str, float, float]] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    connections: list[tuple[str, list[str]]] = field(default_factory=list)
    keys: dict[str, dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def load(text: str, env: dict[str, str] | None = None, strict: bool = False) -> Config:
    """A configuration from TOML text. Unknown sections warn, or fail with ``strict``."""
    raw = expand(tomllib.loads(text), env)
    odd = sorted(set(raw) - KNOWN)
    if odd and strict:
        raise ValueError(f"unknown sections: {odd}")
    out = Config(warnings=[f"unknown section {x}" for x in odd])
    pii = raw.get("pii", {})
    custom = {c["name"]: c["pattern"] for c in pii.get("custom_recognizers", [])}
    if len(custom) != len(pii.get("custom_recognizers", [])):
        raise ValueError("custom recognizers need different names")
    out.engine = Engine(custom=custom, disabled=tuple(pii.get("disabled_recognizers", [])), kinds=tuple(pii["entities"]) if "entities" in pii else None)
    if pii.get("require_ner") and out.engine.ner is None:
        raise ValueError("names are required but there is no model")
    names = set()
    for r in raw.get("guardrails", {}).get("rules", []):
        if r["name"] in names:
            raise ValueError(f"two rules named {r['name']}")
        names.add(r["name"])
        kinds = [kind(k) for k in r.get("entities", [])]
        if set(kinds) - set(PREFIX_OF) - set(custom):
            raise ValueError(f"rule {r['name']}: unknown kinds")
        out.rules.append(Rule(r["name"], r["kind"], r.get("action", "block"), r.get("phase", "pre"), r.get("patterns", []), *([kinds] if kinds else [])))
    for pattern, p in raw.get("prices", {}).items():
        check_pattern(pattern)
        if not all(math.isfinite(p[k]) and p[k] >= 0 for k in ("input", "output")):
            raise ValueError(f"price of {pattern}: finite and not negative")
        out.prices.append((pattern, float(p["input"]), float(p["output"])))
    out.aliases = dict(raw.get("aliases", {}))
    for c in raw.get("connections", []):
        for m in c["models"]:
            check_pattern(m)
        out.connections.append((c["name"], list(c["models"])))
    for i, k in enumerate(raw.get("keys", [])):
        rate, money = k.get("rate"), k.get("budget")
        if rate and not (rate["requests"] > 0 and rate["per_seconds"] > 0):
            raise ValueError("a rate limit needs requests and seconds above zero")
        if money and not (math.isfinite(money["max_usd"]) and money["max_usd"] > 0 and money["per_seconds"] > 0):
            raise ValueError("a budget needs money and seconds above zero")
        out.keys[f"vk-{i}"] = k
    return out


def check_pattern(pattern: str) -> None:
    if not pattern or "*" in pattern[:-1]:
        raise ValueError(f"model pattern {pattern!r}: one star at the end at most")
