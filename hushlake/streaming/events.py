"""Restoring whole event streams: each text that events carry has its own buffer, what is left comes out before the end."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .restore import StreamRestorer, events_of

BLANK = re.compile(r"\n\n|\r\n\r\n")
DATA = re.compile(r"^data: ?(.*?)(\r?)$", re.M)
ANSWER = "answer"


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _carried(style: str, event: dict) -> Iterator[tuple[dict, str, str]]:
    """(holder, field, channel) of each text of an event: the answer is one channel, each tool call or block another, by number."""
    if style == "openai":
        choices = event.get("choices")
        delta = _dict(_dict(choices[0] if isinstance(choices, list) and choices else None).get("delta"))
        yield delta, "content", ANSWER
        for call in delta.get("tool_calls") if isinstance(delta.get("tool_calls"), list) else []:
            yield _dict(_dict(call).get("function")), "arguments", str(_dict(call).get("index", 0))
    elif event.get("type") == "content_block_delta":
        delta = _dict(event.get("delta"))
        if delta.get("type") == "text_delta":
            yield delta, "text", ANSWER
        elif delta.get("type") == "input_json_delta":
            yield delta, "partial_json", str(event.get("index") or 0)


def _parsed(data: str) -> dict | None:
    try:
        event = json.loads(data)
    except ValueError:
        return None
    return event if isinstance(event, dict) else None


def _plain(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class EventRestorer:
    """Feeds of a response's raw text give it with the placeholders in its texts replaced; events may be cut anywhere.

    Styles are "openai" and "anthropic". What a channel holds back at the end marker, or at the end of a
    stream without one, comes as an event of the style's own shape, the answer first, then calls by
    number. What follows the marker passes as it is. ``state`` goes on where another left off.
    """

    def __init__(self, pairs: dict[str, str], style: str, escape: bool = True, state: str | None = None):
        self.restorer, self.style = StreamRestorer(pairs, escape), style
        self.at = json.loads(state) if state else {"buffer": "", "held": {}, "over": False, "id": None, "model": None, "block": 0}

    def state(self) -> str:
        return json.dumps(self.at)

    def feed(self, chunk: str) -> str:
        if self.at["over"]:
            return chunk
        text, out = self.at["buffer"] + chunk, []
        start = 0
        while not self.at["over"] and (end := BLANK.search(text, start)):
            out.append(self._event(text[start : end.end()]))
            start = end.end()
        self.at["buffer"] = "" if self.at["over"] else text[start:]
        return "".join(out) + (text[start:] if self.at["over"] else "")

    def finish(self) -> str:
        if self.at["over"]:
            return ""
        rest, self.at["buffer"] = self.at["buffer"], ""
        out = self._event(rest) if rest else ""
        return out if self.at["over"] else out + self._flush()

    def _ends(self, event: str) -> bool:
        data = [m[1] for m in DATA.finditer(event)]
        if any(d.strip() == "[DONE]" for d in data):
            return True
        named = re.search(r"^event:[ \t]*message_stop[ \t]*\r?$", event, re.M) is not None
        return self.style == "anthropic" and (named or any((_parsed(d) or {}).get("type") == "message_stop" for d in data))

    def _event(self, event: str) -> str:
        return self._flush() + event if self._ends(event) else DATA.sub(lambda m: f"data: {self._value(m[1])}{m[2]}", event)

    def _value(self, data: str) -> str:
        event = _parsed(data)
        if event is None:
            return data
        for k in ("id", "model"):
            if isinstance(event.get(k), str):
                self.at[k] = event[k]
        if event.get("type") == "content_block_delta" and isinstance(event.get("index"), int):
            self.at["block"] = event["index"]
        for holder, field, channel in _carried(self.style, event):
            if isinstance(holder.get(field), str):
                holder[field] = self._through(channel, holder[field])
        return _plain(event)

    def _through(self, channel: str, text: str | None) -> str:
        """The channel's next text, or with None what it still holds."""
        self.restorer.held = self.at["held"].get(channel, "")
        out = self.restorer.finish() if text is None else self.restorer.feed(text)
        self.at["held"][channel] = self.restorer.held
        return out

    def _flush(self) -> str:
        self.at["over"] = True
        order = sorted(self.at["held"], key=lambda c: (c != ANSWER, int(c) if c.isdecimal() else 0))
        return "".join(self._late(c, rest) for c in order if (rest := self._through(c, None)))

    def _late(self, channel: str, rest: str) -> str:
        answer = channel == ANSWER
        if self.style == "anthropic":
            delta = {"type": "text_delta", "text": rest} if answer else {"type": "input_json_delta", "partial_json": rest}
            event = {"type": "content_block_delta", "index": self.at["block"] if answer else int(channel), "delta": delta}
            return f"event: content_block_delta\ndata: {_plain(event)}\n\n"
        delta = {"content": rest} if answer else {"tool_calls": [{"index": int(channel), "function": {"arguments": rest}}]}
        event = {"id": self.at["id"] or "restored", "object": "chat.completion.chunk", "choices": [{"index": 0, "delta": delta, "finish_reason": None}]}
        return f"data: {_plain(event | ({'model': self.at['model']} if self.at['model'] else {}))}\n\n"


def restore_events(chunks: DataFrame, maps: DataFrame, escape: bool = True) -> DataFrame:
    """(response_id, seq, text) of a stream of raw chunks (response_id, style, seq, chunk, last): what of each can go on.

    ``maps`` (response_id, map) is a static table. Chunks of a response come in order of seq over the
    micro-batches; within one they are sorted. The state of a response is its unfinished event and what
    its channels hold back, which no placeholder's length exceeds.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        pairs = next((dict(m) for m in rows["map"] if m is not None), {})
        r = EventRestorer(pairs, rows["style"].iloc[0], escape, state.get[0] if state.exists else None)
        out = [(key[0], seq, r.feed(chunk or "") + (r.finish() if last else "")) for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["last"])]
        state.update((r.state(),))
        yield pd.DataFrame(out, columns=["response_id", "seq", "text"])

    joined = chunks.join(maps, "response_id", "left")
    return joined.groupBy("response_id").applyInPandasWithState(run, "response_id string, seq bigint, text string", "state string", "append", "NoTimeout")


def said(style: str, text: str) -> dict[str, str]:
    """What a whole stream says on each channel."""
    out: dict[str, str] = {}
    for data in events_of(text):
        for holder, field, channel in _carried(style, _parsed(data) or {}):
            if isinstance(holder.get(field), str):
                out[channel] = out.get(channel, "") + holder[field]
    return out


def collect_events(texts: DataFrame) -> DataFrame:
    """``texts`` (style, text) with channels: a map of each whole stream's channels to what they say."""

    @F.pandas_udf("map<string,string>")
    def run(style: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([said(s, t or "") for s, t in zip(style, text)])

    return texts.withColumn("channels", run("style", "text"))
