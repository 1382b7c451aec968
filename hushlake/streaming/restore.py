"""Restoring placeholders in streamed responses, and reading their usage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StreamRestorer:
    """Feeds of chunks give the text with placeholders replaced, as if it had come at once.

    What may still become a placeholder is held back: the longest end that begins one, and a whole one
    at the very end, as a digit may follow. Here only a digit cancels a placeholder, not an underscore.
    """

    def __init__(self, pairs: dict[str, str], escape: bool = False):
        self.names = sorted((k for k in pairs if k), key=lambda k: (-len(k), k))
        self.pairs = {k: json.dumps(v, ensure_ascii=False)[1:-1] if escape else v for k, v in pairs.items()}
        self.find = re.compile("(?:" + "|".join(map(re.escape, self.names)) + ")") if self.names else None
        self.most = max(map(len, self.names), default=0)
        self.held = ""

    def feed(self, chunk: str) -> str:
        return self._run(self.held + chunk, False)

    def finish(self) -> str:
        return self._run(self.held, True)

    def _run(self, text: str, end: bool) -> str:
        out, at = [], 0
        self.held = ""
        if self.find:
            while m := self.find.search(text, at):
                after = text[m.end() : m.end() + 1]
                if not after and not end:
                    break
                out += [text[at : m.start()], m[0] if after.isdigit() and after.isascii() else self.pairs[m[0]]]
                at = m.end()
        rest = text[at:]
        if not end and self.names:
            for n in range(min(self.most, len(rest)), 0, -1):
                if any(k.startswith(rest[-n:]) for k in self.names):
                    self.held, rest = rest[-n:], rest[:-n]
                    break
        return "".join(out) + rest


RESTORED = "response_id string, channel string, seq bigint, text string"


def restore_chunks(chunks: DataFrame, maps: DataFrame) -> DataFrame:
    """(response_id, channel, seq, text) of streamed chunks (response_id, channel, seq, chunk, last): each chunk's restored text.

    ``maps`` (response_id, map) is a static table. Channels of a response are restored apart; the state
    of a channel is what is held back.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        pairs = next((dict(m) for m in rows["map"] if m is not None), {})
        r = StreamRestorer(pairs)
        r.held = state.get[0] if state.exists else ""
        out = []
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["last"]):
            out.append((key[0], key[1], seq, r.feed(chunk or "") + (r.finish() if last else "")))
        state.update((r.held,))
        yield pd.DataFrame(out, columns=["response_id", "channel", "seq", "text"])

    joined = chunks.join(maps, "response_id", "left")
    return joined.groupBy("response_id", "channel").applyInPandasWithState(run, RESTORED, "held string", "append", "NoTimeout")


def events_of(text: str) -> list[str]:
    """The data of the server-sent events in a text, split at blank lines."""
    out = []
    for event in re.split(r"\r?\n\r?\n", text):
        data = [line[5:].lstrip(" ") for line in event.splitlines() if line.startswith("data:")]
        if data:
            out.append("\n".join(data))
    return out


def tap(style: str, text: str) -> tuple[int | None, int | None]:
    """(input, output) tokens of a streamed response: the last usage of one style; of the other input from the start, output from the last delta."""
    i = o = None
    for data in events_of(text):
        try:
            e = json.loads(data)
        except ValueError:
            continue
        if not isinstance(e, dict):
            continue
        if style == "openai":
            u = e.get("usage") or {}
            if "prompt_tokens" in u and "completion_tokens" in u:
                i, o = u["prompt_tokens"], u["completion_tokens"]
        elif e.get("type") == "message_start":
            i = ((e.get("message") or {}).get("usage") or {}).get("input_tokens", i)
        elif e.get("type") == "message_delta":
            o = (e.get("usage") or {}).get("output_tokens", o)
    return i, o


def usage_tap(chunks: DataFrame) -> DataFrame:
    """(response_id, input_tokens, output_tokens) of whole responses, chunks (response_id, style, seq, chunk) put together in order."""
    whole = chunks.groupBy("response_id", "style").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("text"))

    @F.pandas_udf("struct<input_tokens:bigint,output_tokens:bigint>")
    def run(style: pd.Series, text: pd.Series) -> pd.DataFrame:
        got = [tap(s, t) for s, t in zip(style, text)]
        return pd.DataFrame(got, columns=["input_tokens", "output_tokens"]).astype("Int64")

    return whole.select("response_id", run("style", "text").alias("u")).select("response_id", "u.*")
