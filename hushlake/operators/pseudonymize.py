"""Placeholders for personal data, and back."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN
from .detect import values
from .spans import rewrite, widen


def entity_map(found: DataFrame, request: str, order: list[str]) -> DataFrame:
    """(request, prefix, value, placeholder): values numbered from 1 in each request and prefix as first seen in the given order.

    Equal values are one entity; case counts.
    """
    first = found.groupBy(request, "prefix", "value").agg(F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(Window.partitionBy(request, "prefix").orderBy("first"))
    return first.select(request, "prefix", "value", F.concat("prefix", F.lit("_"), n).alias("placeholder"))


def pseudonymize(docs: DataFrame, request: str = "doc_id", leaf: str | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, map): ``docs`` (with spans) and their text rewritten as ``pseudonymized``, and the entity map.

    ``leaf`` numbers the texts of a request. A request's texts share one map. Digits and underscores right behind a
    span go with it: behind a placeholder they would keep it from being restored.
    """
    keys = [request] + ([leaf] if leaf else [])
    found = values(docs.withColumn("spans", widen(F.col(text), F.col("spans"))), text)
    entities = entity_map(found, request, ([leaf] if leaf else []) + ["start"])
    tokens = found.join(entities, [request, "prefix", "value"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("token")))).alias("tokens"))
    out = docs.join(tokens, keys, "left")
    return out.withColumn("pseudonymized", F.when(F.col("tokens").isNull(), F.col(text)).otherwise(rewrite(F.col(text), F.col("tokens")))).drop("tokens"), entities


def restorer(pairs: dict[str, str]):
    """A function that puts values back for placeholders: the longest that fits, unless a digit or an underscore follows; what stands before doesn't matter."""
    names = sorted((k for k in pairs if k), key=lambda k: (-len(k), k))
    if not names:
        return lambda t: t
    find = re.compile("(?:" + "|".join(map(re.escape, names)) + ")(?![0-9_])")
    return lambda t: find.sub(lambda m: pairs[m[0]], t)


def restore(texts: DataFrame, entities: DataFrame, request: str, text: str) -> DataFrame:
    """``texts`` with ``restored``: each request's placeholders replaced by its values."""
    maps = entities.groupBy(request).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("map_"))

    @F.pandas_udf("string")
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or not p else restorer(dict(p))(x) for x, p in zip(t, m)])

    return texts.join(maps, request, "left").withColumn("restored", run(text, "map_")).drop("map_")


def kind_counts(found: DataFrame, request: str) -> DataFrame:
    """(request, prefix, count): different values of each kind."""
    return found.groupBy(request, "prefix").agg(F.countDistinct("value").cast("int").alias("count"))


def map_size(entities: DataFrame, request: str) -> DataFrame:
    """(request, entities, longest): how many placeholders a request's map has and the length of the longest, which bounds what a stream holds back."""
    return entities.groupBy(request).agg(F.count("*").alias("entities"), F.max(F.length("placeholder")).alias("longest"))


def tokens_of(texts: DataFrame, text: str) -> DataFrame:
    """One row for each placeholder in a text: place and token."""
    return texts.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), 1)).alias("place", "token"))


def restore_json(value, restored, parse_arguments: bool = False):
    """A JSON value with every string leaf restored; a string that must hold JSON is parsed and put back, or restored as text if it can't be."""
    if isinstance(value, str):
        if parse_arguments:
            try:
                return json.dumps(restore_json(json.loads(value), restored), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                pass
        return restored(value)
    if isinstance(value, list):
        return [restore_json(v, restored) for v in value]
    if isinstance(value, dict):
        return {k: restore_json(v, restored) for k, v in value.items()}
    return value


def debug_block(texts: DataFrame, request: str) -> DataFrame:
    """(request, debug): JSON of the rewritten texts and how many entities there were, never the values."""
    return texts.groupBy(request).agg(F.to_json(F.struct(F.array_sort(F.collect_list("pseudonymized")).alias("texts"), F.sum(F.size("spans")).alias("entities"))).alias("debug"))
