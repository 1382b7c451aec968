"""Typed event streams in the words of chat chunks, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metering import finish_reason

DONE = "data: [DONE]\n\n"


def _data(json: Column) -> Column:
    return F.concat(F.lit("data: "), json, F.lit("\n\n"))


def chat_chunks(frames: DataFrame) -> DataFrame:
    """(response_id, seq, text) from typed events (response_id, model, created, seq, event, payload): the chat chunks that each one becomes.

    The start gives the role, a delta its text (deltas of tools give nothing); the reason to stop waits
    for the metadata, which gives it with the usage and ends the stream, as does an exception. Events
    after the end are left out; a stream that has no end gets the marker with its last event.
    """
    own = Window.partitionBy("response_id")
    order = own.orderBy("seq")
    event = F.coalesce("event", F.lit(""))
    ends = (event == "metadata") | event.endswith("Exception")
    told = F.when(event == "messageStop", finish_reason(F.get_json_object("payload", "$.stopReason")))
    rows = frames.withColumns(
        {
            "over": F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
            "reason": F.coalesce(F.last(told, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("stop")),
            "cut": ~F.max(ends).over(own) & F.lead("seq").over(order).isNull(),
        }
    ).where(~F.col("over"))

    at = lambda path: F.get_json_object("payload", path)
    head = F.to_json(F.struct(F.col("response_id").cast("string").alias("id"), F.lit("chat.completion.chunk").alias("object"), "created", "model"))
    given, taken, total = (at(f"$.usage.{k}Tokens").try_cast("bigint") for k in ("input", "output", "total"))
    zero = F.lit(0)
    used = F.struct(F.coalesce(given, zero).alias("prompt_tokens"), F.coalesce(taken, zero).alias("completion_tokens"), F.coalesce(total, given + taken, zero).alias("total_tokens"))
    usage = F.when(at("$.usage").startswith("{"), F.concat(F.lit(',"usage":'), F.to_json(used))).otherwise("")

    def chunk(delta: Column, reason: Column, more: Column) -> Column:
        return _data(F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"choices":[{"index":0,"delta":'), delta, F.lit(',"finish_reason":'), reason, F.lit("}]"), more, F.lit("}")))

    none, nothing = F.lit("null"), F.lit("")
    failed = F.to_json(F.struct(F.struct(F.coalesce(at("$.message"), F.lit("upstream stream error")).alias("message"), event.alias("type")).alias("error")))
    text = (
        F.when(event == "messageStart", chunk(F.to_json(F.struct(F.coalesce(at("$.role"), F.lit("assistant")).alias("role"))), none, nothing))
        .when((event == "contentBlockDelta") & at("$.delta.text").isNotNull(), chunk(F.to_json(F.struct(at("$.delta.text").alias("content"))), none, nothing))
        .when(event == "metadata", F.concat(chunk(F.lit("{}"), F.concat(F.lit('"'), F.col("reason"), F.lit('"')), usage), F.lit(DONE)))
        .when(event.endswith("Exception"), F.concat(_data(failed), F.lit(DONE)))
        .otherwise("")
    )
    return rows.withColumn("head", head).select("response_id", "seq", F.concat(text, F.when(F.col("cut"), F.lit(DONE)).otherwise("")).alias("text"))
