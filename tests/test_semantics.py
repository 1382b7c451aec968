"""Cases whose answers are known, and the exact rules that SQL can't check."""

from __future__ import annotations

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from hushlake.functions import checks
from hushlake.operators import bodies, detect, guard, metering, ner, pseudonymize, spans, training
from hushlake.plans import config
from hushlake.sources import stores
from hushlake.streaming.restore import StreamRestorer, events_of, tap


def kinds(text, **k):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in detect.Engine(**k).scan(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Contact alice@example.com for more info.", [("EMAIL_ADDRESS", "alice@example.com")]),
        ("Please transfer to DE89370400440532013000.", [("IBAN_CODE", "DE89370400440532013000")]),
        ("Charge 4111 1111 1111 1111 now.", [("CREDIT_CARD", "4111 1111 1111 1111")]),
        ("IBAN DE89 3704 0044 0532 0130 00 bitte", [("IBAN_CODE", "DE89 3704 0044 0532 0130 00")]),
        ("Hello world, the quick brown fox jumps over the lazy dog.", []),
        ("ruf 089 1234567 an", [("PHONE_NUMBER", "089 1234567")]),
        ("am 24.12.2023 oder 32.01.2023", [("DATE_TIME", "24.12.2023")]),
        ("host 2001:db8::1 up", [("IP_ADDRESS", "2001:db8::1")]),
        ("host 256.1.1.1 no", []),
        ("4111111111111112", []),
        ("x4111111111111111 and 94111111111111111", [("CREDIT_CARD", "4111111111111111")]),
        ("🌍 Nono: alice@example.com — Konto: DE89370400440532013000", [("EMAIL_ADDRESS", "alice@example.com"), ("IBAN_CODE", "DE89370400440532013000")]),
        ("", []),
    ],
)
def test_engine_and_native(spark, text, found):
    assert kinds(text) == found
    row = spark.createDataFrame([(text,)], "text string").select(detect.scan_native(F.col("text")).alias("s")).first()
    native = [(s["kind"], text[s["start"] : s["end"]]) for s in row["s"]]
    assert native == [f for f in found if ":" not in f[1] or f[0] != "IP_ADDRESS"]


def test_overlaps():
    assert kinds("abcdef", custom={"one": "abc", "two": "bcdef"}) == [("one", "abc")]
    assert kinds("abcdef", custom={"one": "abc", "two": "bcdef"}, kinds=("two",)) == []
    assert kinds("say hello world!", custom={"short": "hello", "long": "hello world"}) == [("long", "hello world")]
    assert kinds("TOKEN", custom={"first": "TOKEN", "second": "TOKEN"}) == [("first", "TOKEN")]
    with pytest.raises(ValueError):
        detect.Engine(kinds=("nothing",))
    with pytest.raises(ValueError):
        detect.Engine(custom={"a b": "x"})


def test_null_text(spark):
    d = spark.createDataFrame([(1, None), (2, "a@b.io")], "doc_id int, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in detect.scan(d).collect()} == {1: 0, 2: 1}


def test_merge_and_hmac(spark):
    row = spark.range(1).select(
        spans.merge(F.expr("array(named_struct('start',5,'end',9),named_struct('start',0,'end',3),named_struct('start',3,'end',5),named_struct('start',1,'end',2),named_struct('start',0,'end',3))")).alias("m"),
        checks.hmac_sha256(b"key", F.lit("größe").cast("binary")).alias("h"),
    ).first()
    assert [tuple(x) for x in row["m"]] == [(0, 3), (3, 5), (5, 9)]
    assert row["h"] == hmac.new(b"key", "größe".encode(), hashlib.sha256).hexdigest()


def test_restore_boundaries():
    put = pseudonymize.restorer({"EMAIL_1": "a@b.io", "EMAIL_12": "c@d.io"})
    assert put("EMAIL_1 EMAIL_12 EMAIL_123 XEMAIL_1 EMAIL_1_2") == "a@b.io c@d.io EMAIL_123 Xa@b.io EMAIL_1_2"
    assert pseudonymize.restorer({})("EMAIL_1") == "EMAIL_1"


def naive(text, pairs):
    out, i = "", 0
    while i < len(text):
        for k in sorted(pairs, key=lambda k: (-len(k), k)):
            if text.startswith(k, i):
                after = text[i + len(k) : i + len(k) + 1]
                out += k if after.isdigit() else pairs[k]
                i += len(k)
                break
        else:
            out += text[i]
            i += 1
    return out


def test_stream_restore_by_any_chunks():
    pairs = {"EMAIL_1": " ", "EMAIL_12": "x", "PERSON_3": "Zoë"}
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["EMAIL_1", "EMAIL_12", "PERSON_3", "EMAIL", "_", "1", "2", " ", "ñ日", "PERSON"]) for _ in range(rng.randint(0, 12)))
        r, out, i = StreamRestorer(pairs), "", 0
        while i < len(text):
            n = rng.randint(1, 5)
            out += r.feed(text[i : i + n])
            i += n
            assert len(r.held) <= r.most
        assert out + r.finish() == naive(text, pairs)
    r = StreamRestorer({"EMAIL_1": 'say "hi"'}, escape=True)
    assert r.feed("EMAIL_1") + r.finish() == 'say \\"hi\\"'


def test_bodies():
    body = {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "tool_result", "content": "b"}, {"type": "image", "text": "no"}]}, {"role": "assistant", "content": "c"}]}
    assert [t for _, _, t in bodies.request_leaves("anthropic", body)] == ["s", "a", "b", "c"]
    assert [t for _, _, t in bodies.request_leaves("openai", body)] == ["a", "c"]
    assert [t for _, _, t in bodies.request_leaves("embeddings", {"input": ["x", 1, "y"]})] == ["x", "y"]
    out = bodies.restore_response("openai", json.dumps({"choices": [{"message": {"content": "hi EMAIL_1", "tool_calls": [{"function": {"arguments": '{"to": "EMAIL_1"}'}}, {"function": {"arguments": "not json EMAIL_1"}}]}}]}), {"EMAIL_1": 'a"b'})
    m = json.loads(out)["choices"][0]["message"]
    assert m["content"] == 'hi a"b'
    assert json.loads(m["tool_calls"][0]["function"]["arguments"]) == {"to": 'a"b'}
    assert m["tool_calls"][1]["function"]["arguments"] == 'not json a"b'


def test_rate_limit_and_budget(spark):
    rows = [("k", f"r{i}", i * 250, 0.4) for i in range(6)]
    u = spark.createDataFrame(rows, "key_id string, request_id string, ts_unix_ms bigint, cost_usd double")
    got = {r["request_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in metering.rate_limit(u, 2, 2).collect()}
    assert got == {"r0": (True, 1, None), "r1": (True, 0, None), "r2": (False, None, 1), "r3": (False, None, 1), "r4": (True, 0, None), "r5": (False, None, 1)}
    got = {r["request_id"]: (r["allowed"], round(r["spent"], 9)) for r in metering.budget(u, 1.0, 1).collect()}
    assert got == {"r0": (True, 0.0), "r1": (True, 0.4), "r2": (True, 0.8), "r3": (False, 1.2), "r4": (True, 0.0), "r5": (True, 0.4)}


def test_cost_fixture(spark):
    u = spark.createDataFrame([("gpt-4o", 1_000_000, 500_000), ("gpt-4-turbo", 1_000_000, 0), ("claude-3", 1, 1), ("gpt-4o", None, 1)], "model string, input_tokens bigint, output_tokens bigint")
    got = [r["cost_usd"] for r in metering.with_cost(u, [("gpt-4o", 2.5, 10.0), ("gpt-4*", 30.0, 60.0)]).collect()]
    assert got == [7.5, 30.0, None, None]


def test_guard_order(spark):
    rules = [guard.Rule("a", "banned_content", "flag", "pre", ["x"]), guard.Rule("b", "banned_content", "flag", "pre", ["y"]), guard.Rule("c", "banned_content", "redact", "both", ["zz"]), guard.Rule("d", "prompt_injection", "block", "post")]
    d = spark.createDataFrame([("xy",), ("xzz",), ("you are now",), ("",), (None,)], "text string")
    told = lambda *names: "; ".join(f"guardrail `{n}` matched (1 span(s))" for n in names)
    run = lambda phase: [tuple(r[0])[:3] for r in d.select(guard.evaluate(F.col("text"), F.array().cast(spans.SPAN), rules, phase)).collect()]
    assert run("pre") == [("flag", None, told("a", "b")), ("redact", None, None), ("flag", None, told("b")), ("allow", None, None), ("allow", None, None)]
    assert run("post")[2] == ("block", "d", None)


def test_bio(spark):
    tags = [("B-PER", 0), ("I-PER", 1), ("I-ORG", 2), ("O", 2), ("B-PER", 3), ("B-PER", 4), ("O", 5), ("I-LOC", 6)]
    t = spark.createDataFrame([(1, i, w, i * 2, i * 2 + 1, tag, 0.5) for i, (tag, w) in enumerate(tags)], "request_id int, tok_no long, word_id int, byte_start int, byte_end int, tag string, score double")
    got = sorted((r["start"], r["end"], r["kind"]) for r in ner.decode(t).collect())
    assert got == [(0, 3, "PERSON"), (4, 7, "ORGANIZATION"), (8, 9, "PERSON"), (10, 11, "PERSON"), (14, 15, "LOCATION")]


def test_best_first(spark):
    e = "array(named_struct('start',0,'end',5,'label','A','score',0.5D),named_struct('start',3,'end',6,'label','B','score',0.9D),named_struct('start',6,'end',8,'label','C','score',0.1D))"
    got = spark.range(1).select(ner.best_first(F.expr(e)).alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in got] == [(3, 6), (6, 8)]


def test_training_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"text": "Anna in Köln", "entities": [{"start": 0, "end": 4, "label": "PER"}]}\n\n{"text": "x", "entities": [{"start": 0, "end": 9, "label": "PER"}]}\nnot json\n', encoding="utf-8")
    rows = training.read(spark, str(p))
    assert [r["error"] for r in rows.collect()] == [None, "out of range", "no text"]
    training.write(rows.where("error is null"), str(tmp_path / "out"))
    assert training.read(spark, str(tmp_path / "out")).first()["text"] == "Anna in Köln"
    s = training.synthesize(spark, 50).collect()
    assert all(r["text"][e["start"] : e["end"]] in training.NAMES[e["label"]] for r in s for e in r["entities"])


def test_stores(spark, tmp_path):
    u = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 7)], "request_id string, ts_unix_ms bigint, v int")
    path = str(tmp_path / "usage")
    stores.record_usage(u, path)
    stores.record_usage(u.withColumn("v", F.lit(0)), path)
    assert sorted((r["request_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 7)]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z", "r", "x" * 70000)], "ts string, request_id string, output string")
    stores.write_traces(t, str(tmp_path / "t"))
    assert len(stores.read_traces(spark, str(tmp_path / "t")).first()["output"]) < 70000
    assert stores.retain(spark, str(tmp_path / "t"), "2024-02-01") == ["2024-01-01"]
    frame = stores.encode_frame("delta", {"a": 1})
    assert stores.decode_frames(frame + frame) == [("delta", '{"a": 1}')] * 2
    with pytest.raises(ValueError):
        stores.decode_frames(frame[:-1] + b"\0")


def test_tap():
    text = 'data: {"type":"message_start","message":{"usage":{"input_tokens":3}}}\r\n\r\nevent: x\ndata: {"type":"message_delta","usage":{"output_tokens":5}}\n\ndata: [DONE]\n\n'
    assert tap("anthropic", text) == (3, 5)
    assert len(events_of(text)) == 3
    assert tap("openai", 'data: {"usage":{"prompt_tokens":1,"completion_tokens":2}}\n\ndata: {"usage":null}\n\n') == (1, 2)


def test_config():
    c = config.load('[pii]\nentities = ["email", "order"]\ncustom_recognizers = [{name = "order", pattern = "ORD-[0-9]+"}]\n[prices."a*"]\ninput = 1\noutput = 2\n[[connections]]\nname = "${N}"\nmodels = ["a*"]\n[odd]\n', {"N": "east"})
    assert c.prices == [("a*", 1.0, 2.0)] and c.connections == [("east", ["a*"])] and c.warnings
    assert c.engine.kinds == ("EMAIL_ADDRESS", "order")
    for bad in ("x = '${NOPE}'", "[odd]", '[prices."a*b"]\ninput=1\noutput=1', "[[keys]]\nrate={requests=0,per_seconds=1}"):
        with pytest.raises(ValueError):
            config.load(bad, {}, strict=True)


def _tokens(spark, rows):
    return spark.createDataFrame([("r", i, w, 4 * i, 4 * i + 4, tag, score) for i, (w, tag, score) in enumerate(rows)], "request_id string, tok_no long, word_id long, byte_start int, byte_end int, tag string, score double")


def test_decode_carries_a_word_through_tokens_tagged_o(spark):
    from hushlake.operators import ner

    got = lambda rows: sorted((r["start"], r["end"], r["kind"], r["score"]) for r in ner.decode(_tokens(spark, rows)).collect())
    assert got([(0, "B-PER", 0.9), (0, "O", 0.1), (0, "I-PER", 0.7)]) == [(0, 12, "PERSON", 0.8)]
    assert got([(0, "B-PER", 0.9), (1, "O", 0.1), (2, "I-PER", 0.7)]) == [(0, 4, "PERSON", 0.9), (8, 12, "PERSON", 0.7)]
    assert got([(0, "I-ORG", 0.5), (1, "I-ORG", 0.7), (2, "I-LOC", 0.4), (2, "B-ORG", 0.6), (3, "B-LOC", 1.0)]) == [(0, 8, "ORGANIZATION", 0.6), (8, 16, "LOCATION", 0.5), (16, 20, "LOCATION", 1.0)]
    assert got([(None, "B-PER", 0.5), (None, "O", 0.5), (None, "I-PER", 0.5)]) == [(0, 4, "PERSON", 0.5), (8, 12, "PERSON", 0.5)]
    assert got([(0, "O", 0.5)]) == []


def test_dedupe_of_chains(spark):
    from hushlake.operators import ner

    def run(*spans):
        d = spark.createDataFrame([([*spans],)], "s array<struct<start:int,end:int,kind:string,score:double>>")
        return [tuple(x) for x in d.select(ner.dedupe(F.col("s")).alias("s")).first()["s"]]

    assert run((0, 10, "P", 0.9), (5, 20, "P", 0.5), (15, 30, "P", 0.3)) == [(0, 10, "P", 0.9), (15, 30, "P", 0.3)]
    assert run((0, 10, "P", 0.4), (5, 20, "P", 0.5), (15, 30, "P", 0.3)) == [(5, 20, "P", 0.5)]
    assert run((0, 10, "P", 0.4), (0, 10, "P", 0.6), (0, 10, "L", 0.1)) == [(0, 10, "L", 0.1), (0, 10, "P", 0.6)]
    assert run() == []


def test_align_learns_the_first_token_of_an_entity(spark):
    from hushlake.operators import training

    d = spark.createDataFrame([([(0, 5, "PER"), (10, 14, "LOC")], [(0, 0, None), (0, 2, 0), (2, 5, 0), (6, 9, 1), (10, 12, 2), (12, 14, 2), (15, 17, 3), (17, 19, 3), (0, 0, None)])], "entities array<struct<start:int,end:int,label:string>>, tokens array<struct<start:int,end:int,word_id:int>>")
    assert training.align(d).first()["labels"] == ["-100", "B-PER", "-100", "O", "B-LOC", "-100", "O", "O", "-100"]


def test_contents_in_parts(spark):
    from hushlake.operators import bodies, metering

    parts = [{"type": "text", "text": "one"}, {"type": "image"}, {"text": 5}, {"text": "two"}]
    body = {"messages": [{"role": "system", "content": "be"}, {"role": "system", "content": [{"text": "kind"}]}, {"role": "user", "content": parts}, {"content": "[1]"}, {"role": "user"}], "max_tokens": 5, "max_completion_tokens": 7, "top_p": 0.5, "stop": "END"}
    rows = [(json.dumps(body),), (json.dumps({"messages": [{"role": "user", "content": "x"}], "stop": ["a", "b"]}),), (json.dumps({"messages": []}),), (json.dumps({"system": [{"text": "s"}], "messages": [{"role": "user", "content": "x"}]}),)]
    d = spark.createDataFrame(rows, "body string")
    assert [r[0] for r in d.select(bodies.request_text(F.col("body"))).collect()] == ["be\nkind\none\ntwo\n[1]", "x", "", "x"]
    assert d.select(bodies.request_text(F.col("body"), "anthropic")).collect()[3][0] == "s\nx"
    got = [json.loads(r[0]) for r in d.select(metering.converse_request(F.col("body"))).collect()]
    text = lambda *t: [{"text": x} for x in t]
    assert got[0] == {"system": text("be", "kind"), "messages": [{"role": "user", "content": text("one", "two")}, {"role": "user", "content": text("[1]")}, {"role": "user", "content": []}], "inferenceConfig": {"maxTokens": 7, "topP": 0.5, "stopSequences": ["END"]}}
    assert got[1]["inferenceConfig"] == {"stopSequences": ["a", "b"]} and got[2] == {"messages": []} and "system" not in got[3]
    r = spark.createDataFrame([('{"output":{"message":{"content":[{"text":"a"},{"x":1},{"text":"b"}]}},"stopReason":"malformed_tool_use","usage":{"inputTokens":2,"outputTokens":3}}',)], "b string").select(metering.converse_response(F.col("b")).alias("r")).first()["r"]
    assert tuple(r) == ("ab", "tool_calls", 2, 3, 5)


def test_limits_of_a_key_with_many_rows(spark):
    from hushlake.operators import metering

    u = spark.range(50_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key_id"), F.format_string("r%06d", "id").alias("request_id"), (F.col("id") * 10).alias("ts_unix_ms"), F.lit(0.5).alias("cost_usd"))
    got = metering.rate_limit(u, 5, 1)
    assert got.count() == 50_000
    hot = got.where("key_id = 'hot'").orderBy("ts_unix_ms").collect()
    assert [r["allowed"] for r in hot[:7]] == [True] * 5 + [False] * 2 and abs(sum(r["allowed"] for r in hot) - 2505) <= 2
    spent = metering.budget(u, 2.0, 100).where("key_id = 'hot'").orderBy("ts_unix_ms").collect()
    assert [r["spent"] for r in spent[:6]] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.0] and [r["allowed"] for r in spent[:6]] == [True] * 4 + [False] * 2
    assert metering.rate_limit(u.limit(0), 5, 1).collect() == []
