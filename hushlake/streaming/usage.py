"""Streams of usage events: windows, first writes, limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import append


def windowed(usage: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests, tokens and cost by window of event time; events later than ``late`` behind the latest are left out."""
    rows = usage.withColumn("at", F.timestamp_millis("ts_unix_ms")).withWatermark("at", late).groupBy(F.window("at", length))
    out = rows.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )
    return out.select(F.unix_millis("window.start").alias("bucket_ms"), "requests", "input_tokens", "output_tokens", "errors")


def first_writes(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each request id within the time that is waited for late ones."""
    return usage.withColumn("at", F.timestamp_millis("ts_unix_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"]).drop("at")


def record(usage: DataFrame, path: str, checkpoint: str):
    """A query that appends each batch's new events; a batch that is run again adds nothing."""
    from ..sources.stores import record_usage

    return usage.writeStream.foreachBatch(lambda batch, _: record_usage(batch, path)).option("checkpointLocation", checkpoint)


def deliver(events: DataFrame, path: str, secret: bytes, checkpoint: str):
    """A query that writes signed payloads; each batch is delivered from its checkpoint, none is dropped."""
    from ..sources.stores import signed

    def batch(rows: DataFrame, _: int) -> None:
        payload = F.to_json(F.struct(*rows.columns))
        append(rows.select(payload.alias("payload")).withColumn("signature", signed(F.col("payload"), secret)), path)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


DECISION = "key_id string, request_id string, ts_unix_ms bigint, allowed boolean, remaining bigint, retry_after bigint"


def rate_limit(usage: DataFrame, capacity: int, seconds: int) -> DataFrame:
    """The token bucket of ``operators.metering.rate_limit`` on a stream: a key's state is two numbers, however many requests it has."""
    every = seconds / capacity

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(frames)).sort_values(["ts_unix_ms", "request_id"])
        out = []
        for request, ts in zip(rows["request_id"], rows["ts_unix_ms"].astype("int64")):
            tokens = min(tokens + max(ts - at if at is not None else 0, 0) / 1000.0 * (1.0 / every), float(capacity))
            at, ok = int(ts), tokens >= 1.0
            tokens -= ok
            out.append((key[0], request, at, ok, int(tokens) if ok else None, None if ok else int(-(-(1.0 - tokens) * every // 1))))
        state.update((float(tokens), at))
        yield pd.DataFrame(out, columns=["key_id", "request_id", "ts_unix_ms", "allowed", "remaining", "retry_after"]).astype({"remaining": "Int64", "retry_after": "Int64"})

    return usage.groupBy("key_id").applyInPandasWithState(run, DECISION, "tokens double, at bigint", "append", "NoTimeout")
