"""Event streams: restored channel by channel, and typed ones in chat chunks."""

from __future__ import annotations

import json
import random
import tarfile

from pyspark.sql import functions as F

from hushlake.operators import training
from hushlake.sources import stores
from hushlake.streaming import converse
from hushlake.streaming.events import EventRestorer, said

PAIRS = {"EMAIL_1": "a@b.de", "EMAIL_12": "c@d.de", "PERSON_1": 'A "B"'}


def chat(**delta) -> str:
    return "data: " + json.dumps({"id": "x", "model": "m", "choices": [{"delta": delta}]}) + "\n\n"


def call(index: int, text: str) -> str:
    return chat(tool_calls=[{"index": index, "function": {"arguments": text}}])


def run(text: str, style: str, cuts: list[int], escape: bool = True) -> str:
    state, out = None, ""
    for a, b in zip([0, *cuts], [*cuts, len(text)]):  # the state travels as text between chunks
        r = EventRestorer(PAIRS, style, escape, state)
        out += r.feed(text[a:b])
        state = r.state()
    return out + EventRestorer(PAIRS, style, escape, state).finish()


def test_channels_are_apart_and_chunks_do_not_matter():
    stream = ": note\r\n\r\n" + chat(content="to EMA") + call(1, '{"a":"EM') + call(0, '"PERSON') + chat(content="IL_1") + call(1, 'AIL_12"') + call(0, "_1") + "data: [DONE]\n\ndata: EMAIL_1\n\n"
    whole = run(stream, "openai", [])
    assert said("openai", whole) == {"answer": "to a@b.de", "1": '{"a":"c@d.de"', "0": '"A \\"B\\"'}
    assert whole.endswith("data: [DONE]\n\ndata: EMAIL_1\n\n") and whole.startswith(": note\r\n\r\n")
    late = [json.loads(e[6:]) for e in whole.split("\n\n")[-5:-3]]
    assert [list(e["choices"][0]["delta"]) for e in late] == [["content"], ["tool_calls"]] and late[0]["id"] == "x" and late[0]["model"] == "m"
    rng = random.Random(1)
    for _ in range(200):
        assert run(stream, "openai", sorted(rng.sample(range(len(stream)), rng.randint(0, 12)))) == whole


def test_blocks_end_with_a_stop_or_with_the_stream():
    block = lambda i, kind, field, text: "event: content_block_delta\ndata: " + json.dumps({"type": "content_block_delta", "index": i, "delta": {"type": kind, field: text}}) + "\n\n"
    stream = block(2, "text_delta", "text", "EMAIL_1") + block(4, "input_json_delta", "partial_json", "EMAIL_1")
    for end in ("", "event: message_stop\ndata: {}\n\n", 'data: {"type":"message_stop"}\n\n'):
        got = run(stream + end, "anthropic", [5, 90])
        assert said("anthropic", got) == {"answer": "a@b.de", "4": "a@b.de"} and got.endswith(end)
        assert '"index":4,"delta":{"type":"input_json_delta","partial_json":"a@b.de"}' in got


def test_what_is_no_event_passes():
    for text in ("", "data: nothing\n\n", "data: 5\n\n", 'data: {"choices":[]}\n\n', 'data: {"choices":null}\n\n', 'data: {"choices":[{"delta":{"content":null,"tool_calls":[5,{"function":null}]}}]}\n\n', "EMAIL_1"):
        assert run(text, "openai", []) == text
        assert run(text, "anthropic", []) == text
    assert said("openai", run(chat(content="PERSON_1 x"), "openai", [], escape=False)) == {"answer": 'A "B" x'}


def test_typed_stream_in_chat_chunks(spark):
    frames = [("a", 1, "messageStart", "{}"), ("a", 2, "contentBlockDelta", '{"delta":{"toolUse":{}}}'), ("a", 3, "odd", None), ("a", 4, None, None), ("a", 5, "metadata", "{}"), ("a", 6, "metadata", "{}")]
    frames += [("b", 1, "messageStop", '{"stopReason":"tool_use"}'), ("b", 2, "metadata", '{"usage":{"inputTokens":3}}'), ("c", 1, "xException", "{}"), ("d", 1, "contentBlockDelta", '{"delta":{"text":"é\\"\\n"}}')]
    d = spark.createDataFrame([(r, "m", 7, s, e, p) for r, s, e, p in frames], "response_id string, model string, created long, seq long, event string, payload string")
    got = {}
    for r in converse.chat_chunks(d).orderBy("response_id", "seq").collect():
        got[r["response_id"]] = got.get(r["response_id"], "") + r["text"]
    events = {k: [json.loads(e[6:]) if e[6:] != "[DONE]" else None for e in v.split("\n\n")[:-1]] for k, v in got.items()}
    assert all(e[-1] is None and None not in e[:-1] for e in events.values())
    assert [e["choices"][0] for e in events["a"][:-1]] == [{"index": 0, "delta": {"role": "assistant"}, "finish_reason": None}, {"index": 0, "delta": {}, "finish_reason": "stop"}]
    assert "usage" not in events["a"][1] and events["b"][0]["choices"][0]["finish_reason"] == "tool_calls"
    assert events["b"][0]["usage"] == {"prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 0}
    assert events["c"][0] == {"error": {"message": "upstream stream error", "type": "xException"}}
    assert events["d"][0]["choices"][0]["delta"] == {"content": 'é"\n'} and events["d"][0]["created"] == 7
    assert converse.chat_chunks(d.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    lines = tmp_path / "t.jsonl"
    lines.write_text("".join(json.dumps({"request_id": f"r{i}", "status": i}) + "\n" for i in range(9000)) + "\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(lines, "t-1.jsonl")
        tar.add(lines, "t-2.jsonl")
        tar.add(lines, "readme.txt")
    got = stores.read_archives(spark, str(tmp_path))
    assert got.count() == 18000 and got.where("request_id = concat('r', status)").count() == 18000


def test_annotate(spark):
    found = {"x": [(0, 5, "P", 0.5), (3, 9, "P", 0.5), (9, 11, "Q", 0.9), (12, 13, "P", 0.3), (5, 6, "odd", 1.0)]}
    d = spark.createDataFrame([("x",), (" \t",), ("",), (None,), ("y",)], "text string")
    got = {r["text"]: [tuple(e) for e in r["entities"]] for r in training.annotate(d, lambda t: found.get(t, []), {"P": "PER", "Q": "LOC"}).collect()}
    assert got == {"x": [(3, 9, "PER"), (9, 11, "LOC")], "y": []}
    assert training.annotate(d, lambda t: [], {}).where(F.size("entities") > 0).count() == 0
