"""Cost, routing, limits and usage of requests."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import RETRIABLE
from .bodies import texts

ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def longest_match(name: Column, patterns: list[str], value) -> Column:
    """value(pattern) of the exact pattern or else the longest "prefix*"; null if none fits. Patterns are configuration: they become one expression, no join."""
    exact = [p for p in patterns if not p.endswith("*")]
    wild = sorted((p for p in patterns if p.endswith("*")), key=lambda p: (-len(p), patterns.index(p)))
    out = None
    for p in [*exact, *wild]:
        hit = name == p if p in exact else name.startswith(p[:-1])
        out = F.when(hit, value(p)) if out is None else out.when(hit, value(p))
    return F.lit(None) if out is None else out


def with_cost(usage: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """cost_usd from prices (model pattern, in, out) per million tokens; null without a price or a token count."""
    table = {p: (i, o) for p, i, o in prices}
    price = lambda k: longest_match(F.col("model"), list(table), lambda p: F.lit(table[p][k]))
    million = F.lit(1_000_000.0)
    return usage.withColumn("cost_usd", F.col("input_tokens") / million * price(0) + F.col("output_tokens") / million * price(1))


def routes(requests: DataFrame, connections: list[tuple[str, list[str]]], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """``requests`` (key_id, model) with candidates, the connections to try in order, and error.

    Exact names come first in the order of configuration, then wildcards by longest prefix, ties in
    that order. A key with an allow-list may only ask for what it names.
    """
    model = F.col("model")
    exact = [(i, name) for i, (name, models) in enumerate(connections) if [m for m in models if not m.endswith("*")]]
    hits: list[Column] = []
    for i, name in exact:
        names = [m for m in connections[i][1] if not m.endswith("*")]
        hits.append(F.when(model.isin(names), F.struct(F.lit(0).alias("rank"), F.lit(i).alias("place"), F.lit(name).alias("name"))))
    for i, (name, models) in enumerate(connections):
        names = [m for m in models if not m.endswith("*")]
        length = longest_match(model, [m for m in models if m.endswith("*")], lambda p: F.lit(len(p)))
        fit = length.isNotNull() if not names else length.isNotNull() & ~model.isin(names)
        hits.append(F.when(fit, F.struct((F.lit(1000) - length).cast("int").alias("rank"), F.lit(i).alias("place"), F.lit(name).alias("name"))))
    found = F.transform(F.array_sort(F.filter(F.array(*hits), lambda h: h.isNotNull())), lambda h: h["name"])
    may = F.lit(True)
    for key, patterns in (allowed or {}).items():
        ok = longest_match(model, patterns, lambda p: F.lit(True)).isNotNull()
        may = may & ((F.col("key_id") != key) | ok)
    error = F.when(~may, "model_not_allowed").when(F.size(found) == 0, "unknown_model")
    none = F.array().cast("array<string>")
    return requests.withColumn("error", error).withColumn("candidates", F.when(may, found).otherwise(none))


def allowed_models(connections: list[tuple[str, list[str]]], patterns: list[str] | None) -> list[str]:
    """The models that a key may name: exact ones as first seen, then wildcards, each once."""
    every = [m for _, models in connections for m in models]
    ordered = dict.fromkeys([m for m in every if not m.endswith("*")] + [m for m in every if m.endswith("*")])
    fits = lambda m: patterns is None or any(m == p or (p.endswith("*") and m.startswith(p[:-1])) for p in patterns)
    return [m for m in ordered if fits(m)]


def resolve_alias(model: Column, aliases: dict[str, str]) -> Column:
    """One look-up, not followed further."""
    out = model
    for name, to in aliases.items():
        out = F.when(model == name, to).otherwise(out)
    return out


def tool_route(tool: Column, servers: list[str]) -> Column:
    """The server with the longest name that the tool's name starts with, and a dash after."""
    return longest_match(tool, [f"{s}-*" for s in servers], lambda p: F.lit(p[:-2]))


def retriable(status: Column) -> Column:
    return status.isin(RETRIABLE)


def fallback(attempts: Column) -> Column:
    """(status, attempts) of tries in order, statuses: the first that may not be retried, else the last, and how many came before it."""
    final = F.filter(F.transform(attempts, lambda s, i: F.struct(s.alias("status"), i.alias("attempts"))), lambda x: ~retriable(x["status"]))
    last = F.struct(F.element_at(attempts, -1).alias("status"), (F.size(attempts) - 1).alias("attempts"))
    return F.coalesce(F.get(final, F.lit(0)), last)


def openai_usage(body: Column) -> Column:
    """(input, output) of a chat body; null unless both counts are there."""
    i, o = (F.get_json_object(body, f"$.usage.{k}").try_cast("long") for k in ("prompt_tokens", "completion_tokens"))
    return F.when(i.isNotNull() & o.isNotNull(), F.struct(i.alias("input"), o.alias("output")))


def anthropic_usage(body: Column) -> Column:
    i, o = (F.get_json_object(body, f"$.usage.{k}").try_cast("long") for k in ("input_tokens", "output_tokens"))
    return F.when(i.isNotNull() & o.isNotNull(), F.struct(i.alias("input"), o.alias("output")))


def finish_reason(reason: Column) -> Column:
    # Reasons of one wire format in the other's words.
    return (
        F.when(reason.isin("max_tokens", "model_context_window_exceeded"), "length")
        .when(reason.isin("tool_use", "malformed_tool_use"), "tool_calls")
        .when(reason.isin("content_filtered", "guardrail_intervened"), "content_filter")
        .otherwise("stop")
    )


def _fold(usage: DataFrame, order: list[str], schema: str, start, step) -> DataFrame:
    """A fold over each key's rows in order: ``step`` takes the state and a row and returns the next state and what it adds to the row's key.

    Rows are sorted within partitions and read batch by batch, so that a key of any number of rows costs
    its rows once and holds a state alone.
    """
    rows = usage.select("key_id", *order).repartition("key_id").sortWithinPartitions("key_id", *order)
    target = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches):
        key, state, fresh = None, None, True
        for batch in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or k != key:
                    key, state, fresh = k, start, False
                state, found = step(state, *row)
                out.append((k, *found))
            columns = list(zip(*out)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], names=target.names)

    return rows.mapInArrow(run, schema)


def rate_limit(usage: DataFrame, capacity: int, seconds: int) -> DataFrame:
    """(key_id, request_id, ts_unix_ms, allowed, remaining, retry_after): a token bucket for each key, requests in order of time, then id.

    It starts full, fills evenly and never beyond ``capacity``; a request takes one token or is refused.
    """
    every = seconds / capacity

    def step(state, ts, request):
        tokens, at = state
        passed = max(ts - (ts if at is None else at), 0) / 1000.0
        have = min(tokens + passed * (1.0 / every), float(capacity))
        if have >= 1.0:
            return (have - 1.0, ts), (request, ts, True, math.floor(have - 1.0), None)
        return (have, ts), (request, ts, False, None, math.ceil((1.0 - have) * every))

    schema = "key_id string, request_id string, ts_unix_ms bigint, allowed boolean, remaining bigint, retry_after bigint"
    return _fold(usage, ["ts_unix_ms", "request_id"], schema, (float(capacity), None), step)


def rate_snapshot(decisions: DataFrame) -> DataFrame:
    """What each key's bucket holds after its last request: (key_id, ts_unix_ms, allowed, remaining)."""
    last = F.max_by(F.struct("ts_unix_ms", "allowed", "remaining"), F.struct("ts_unix_ms", "request_id")).alias("s")
    return decisions.groupBy("key_id").agg(last).select("key_id", "s.ts_unix_ms", "s.allowed", F.coalesce("s.remaining", F.lit(0)).alias("remaining"))


def budget(usage: DataFrame, most: float, seconds: int) -> DataFrame:
    """(key_id, request_id, ts_unix_ms, allowed, spent, retry_after): a spending window for each key.

    A window opens at the first cost above zero and ends ``seconds`` later. A request is allowed while
    less than ``most`` is spent, so the last may overshoot; its cost counts if it is allowed.
    """
    length = seconds * 1000

    def step(state, ts, request, cost):
        spent, opened = state
        if opened is not None and ts - opened >= length:
            spent, opened = 0.0, None
        if spent < most:
            paid = cost or 0.0
            found = (request, ts, True, spent, None)
            return (spent + paid, ts if opened is None and paid > 0 else opened), found
        wait = 0 if opened is None else math.ceil((length - (ts - opened)) / 1000.0)
        return (spent, opened), (request, ts, False, spent, wait)

    schema = "key_id string, request_id string, ts_unix_ms bigint, allowed boolean, spent double, retry_after bigint"
    return _fold(usage, ["ts_unix_ms", "request_id", "cost_usd"], schema, (0.0, None), step)


def budget_snapshot(decisions: DataFrame) -> DataFrame:
    """The last decision of each key."""
    last = F.max_by(F.struct("request_id", "allowed", "spent"), F.struct("ts_unix_ms", "request_id")).alias("s")
    return decisions.groupBy("key_id").agg(last).select("key_id", "s.request_id", "s.allowed", F.round("s.spent", 6).alias("spent"))


def tool_catalog(servers: dict[str, DataFrame | None]) -> DataFrame | None:
    """One list of the tools (name, description) of all servers, names with the server's in front; servers that failed (None) are left out."""
    out = None
    for name, tools in servers.items():
        if tools is not None:
            own = tools.select(F.concat(F.lit(f"{name}-"), "name").alias("name"), "description", F.lit(name).alias("server"))
            out = own if out is None else out.unionByName(own)
    return out


def converse_response(body: Column) -> Column:
    """A response of the typed wire format as (content, finish_reason, prompt_tokens, completion_tokens, total_tokens); a total that isn't given is the sum."""
    schema = "output struct<message:struct<content:array<struct<text:string>>>>, stopReason string, usage struct<inputTokens:bigint,outputTokens:bigint,totalTokens:bigint>"
    p = F.from_json(body, schema)
    said = F.filter(F.transform(p["output"]["message"]["content"], lambda c: c["text"]), lambda t: t.isNotNull())
    used = p["usage"]
    return F.struct(
        F.array_join(said, "").alias("content"),
        finish_reason(p["stopReason"]).alias("finish_reason"),
        used["inputTokens"].alias("prompt_tokens"),
        used["outputTokens"].alias("completion_tokens"),
        F.coalesce(used["totalTokens"], used["inputTokens"] + used["outputTokens"]).alias("total_tokens"),
    )


def converse_request(body: Column) -> Column:
    """A chat request in the typed wire format: system texts apart, each content a list of its texts, limits only where given.

    max_completion_tokens goes before max_tokens; stop is one string or a list.
    """
    v = F.try_parse_json(body)
    part = "array<struct<role:string,content:variant>>"
    said = F.transform(F.try_variant_get(v, "$.messages", part), lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.transform(texts(m["content"]), lambda t: F.struct(t.alias("text"))).alias("content")))
    system = F.flatten(F.transform(F.filter(said, lambda m: m["role"] == "system"), lambda m: m["content"]))
    number = lambda path, t: F.try_variant_get(v, path, t)
    limits = {
        "maxTokens": F.coalesce(number("$.max_completion_tokens", "bigint"), number("$.max_tokens", "bigint")),
        "temperature": number("$.temperature", "double"),
        "topP": number("$.top_p", "double"),
        "stopSequences": F.nullif(texts(F.try_variant_get(v, "$.stop", "variant"), whole=True), F.array().cast("array<string>")),
    }
    some = F.coalesce(*[c.cast("string") for c in limits.values()]).isNotNull()
    return F.to_json(
        F.struct(
            F.when(F.size(system) > 0, system).alias("system"),
            F.filter(said, lambda m: m["role"] != "system").alias("messages"),
            F.when(some, F.struct(*[c.alias(k) for k, c in limits.items()])).alias("inferenceConfig"),
        )
    )
