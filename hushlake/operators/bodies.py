"""Bodies of chat requests and responses as tables of text leaves."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pseudonymize import restore_json, restorer

LEAVES = "array<struct<leaf_no:int,path:string,role:string,text:string>>"


def _content(content, path: str, role, block_types=("text",), nested: bool = False):
    """(path, role, text) of a content: a string, or its text parts; with ``nested`` also those of tool results."""
    if isinstance(content, str):
        yield path, role, content
    elif isinstance(content, list):
        for i, part in enumerate(content):
            if not isinstance(part, dict):
                continue
            if part.get("type") in block_types and isinstance(part.get("text"), str):
                yield f"{path}[{i}].text", role, part["text"]
            elif nested and part.get("type") == "tool_result":
                yield from _content(part.get("content"), f"{path}[{i}].content", role, block_types, nested)


def request_leaves(style: str, body: dict):
    """Texts of a request: "openai" messages, "anthropic" system and messages, "embeddings" input strings."""
    if style == "embeddings":
        given = body.get("input")
        if isinstance(given, str):
            yield "input", None, given
        elif isinstance(given, list):
            yield from ((f"input[{i}]", None, x) for i, x in enumerate(given) if isinstance(x, str))
        return
    if style == "anthropic":
        yield from _content(body.get("system"), "system", "system")
    for i, m in enumerate(body.get("messages") or []):
        if isinstance(m, dict):
            yield from _content(m.get("content"), f"messages[{i}].content", m.get("role"), nested=style == "anthropic")


def leaves(bodies: DataFrame, request: str = "request_id", body: str = "body", style: str = "style") -> DataFrame:
    """(request, leaf_no, path, role, text): a row for each text of a body, in order; a body that isn't a JSON object has none."""

    @F.pandas_udf(LEAVES)
    def run(body: pd.Series, style: pd.Series) -> pd.Series:
        out = []
        for b, s in zip(body, style):
            try:
                parsed = json.loads(b or "null")
            except ValueError:
                parsed = None
            found = request_leaves(s, parsed) if isinstance(parsed, dict) else ()
            out.append([{"leaf_no": i, "path": p, "role": r, "text": t} for i, (p, r, t) in enumerate(found)])
        return pd.Series(out)

    return bodies.select(request, F.explode(run(body, style)).alias("leaf")).select(request, "leaf.*")


def rebuild(bodies: DataFrame, texts: DataFrame, request: str = "request_id", body: str = "body", style: str = "style", text: str = "pseudonymized") -> DataFrame:
    """``bodies`` with the leaves' new texts in place."""
    by_body = texts.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("leaf_no", F.col(text).alias("text")))).alias("new_"))

    @F.pandas_udf("string")
    def run(body: pd.Series, style: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([b if n is None else _put(b, s, [x["text"] for x in n]) for b, s, n in zip(body, style, new)])

    return bodies.join(by_body, request, "left").withColumn("rewritten", run(body, style, "new_")).drop("new_")


def _put(body: str, style: str, texts: list[str]) -> str:
    parsed = json.loads(body)
    for (path, _, _), text in zip(list(request_leaves(style, parsed)), texts):
        *steps, last = [int(x) if x.isdigit() else x for x in path.replace("[", ".").replace("]", "").split(".")]
        at = parsed
        for s in steps:
            at = at[s]
        at[last] = text
    return json.dumps(parsed, ensure_ascii=False, separators=(",", ":"))


def restore_response(style: str, body: str, pairs: dict[str, str]) -> str:
    """A response with its texts and its tools' arguments restored; everything else as it was."""
    put = restorer(pairs)
    parsed = json.loads(body)
    if style == "openai":
        for choice in parsed.get("choices") or []:
            m = choice.get("message") or {}
            if isinstance(m.get("content"), str):
                m["content"] = put(m["content"])
            for call in m.get("tool_calls") or []:
                f = call.get("function") or {}
                if isinstance(f.get("arguments"), str):
                    f["arguments"] = restore_json(f["arguments"], put, parse_arguments=True)
    else:
        for block in parsed.get("content") or []:
            if block.get("type") == "text" and isinstance(block.get("text"), str):
                block["text"] = put(block["text"])
            elif block.get("type") == "tool_use":
                block["input"] = restore_json(block.get("input"), put)
    return json.dumps(parsed, ensure_ascii=False, separators=(",", ":"))


def restore_responses(bodies: DataFrame, maps: DataFrame, request: str = "request_id") -> DataFrame:
    """``bodies`` (request, style, body) with ``restored``, by ``maps`` (request, map of placeholder to value)."""

    @F.pandas_udf("string")
    def run(style: pd.Series, body: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([restore_response(s, b, dict(p) if p is not None and len(p) else {}) for s, b, p in zip(style, body, pairs)])

    return bodies.join(maps.withColumnRenamed("map", "map_"), request, "left").withColumn("restored", run("style", "body", "map_")).drop("map_")


def texts(content: Column, whole: bool = False) -> Column:
    """The texts of a message's content (a variant): of a string the string itself, of a list those of its parts that have one; with ``whole`` parts are strings themselves."""
    own = F.try_variant_get(content, "$", "string")
    parts = F.try_variant_get(content, "$", "array<string>" if whole else "array<struct<text:variant>>")
    if not whole:
        parts = F.transform(parts, lambda p: F.when(F.schema_of_variant(p["text"]) == "STRING", F.try_variant_get(p["text"], "$", "string")))
    kind = F.schema_of_variant(content)
    none = F.array().cast("array<string>")
    return F.when(kind == "STRING", F.array(own)).when(kind.startswith("ARRAY"), F.coalesce(F.array_compact(parts), none)).otherwise(none)


def request_text(body: Column, style: str = "openai") -> Column:
    """The texts of a request, one a line, for guardrails; parts of a content each for itself. Style "anthropic" has the system text first."""
    v = F.try_parse_json(body)
    said = F.flatten(F.transform(F.try_variant_get(v, "$.messages", "array<struct<content:variant>>"), lambda m: texts(m["content"])))
    if style == "anthropic":
        said = F.concat(texts(F.try_variant_get(v, "$.system", "variant")), said)
    return F.array_join(said, "\n")


def chat_bodies(conversations: DataFrame) -> DataFrame:
    """(conv_id, body): a request of each conversation, its turns as messages in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("body"))
