"""Operators on texts, against brute force and known answers, with nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushlake.llm import chat, html_extract, langid, licences, lines, mixing, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, h long, k string"


def docs(spark, rows):
    """Rows (doc_id, text, source, lang); further columns have names that the operators use within."""
    return spark.createDataFrame([(i, t, lang, s, None, 5, 6, "k") for i, t, s, lang in rows], DOCS)


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu")):
    return " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))


def corpus():
    rng = random.Random(2)
    rows = [(i, "\n".join(prose(rng, rng.choice([1, 3, 8, 30])) for _ in range(rng.randint(1, 5))), f"s{i % 4}", "en") for i in range(60)]
    rows += [(60 + i, rows[0][1], "s0", "en") for i in range(5)]
    near = rows[7][1].split(" ")
    for i in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = "other"
        rows.append((70 + i, " ".join(w), "s1", "en"))
    rows += [(90, None, None, None), (91, "", "s9", "en"), (92, " \t\n ", "s9", None), (93, prose(rng, 20_000), "é", "en"), (94, rows[3][1], "s1", "en"), (94, rows[3][1], "s1", "en"), (None, "one two three", "s1", "en")]
    return rows


def test_lines(spark):
    rows = corpus()
    got = {}
    for r in lines.line_report(docs(spark, rows)).collect():
        assert got.setdefault(r["doc_id"], (r["n_lines"], r["n_blank"], r["removed"])) == (r["n_lines"], r["n_blank"], r["removed"])
    seen, wanted = [], {}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        each = (t or "").lower().split("\n") if t is not None else []
        sets = [frozenset(re.findall(r"[^ \t\x0b\f\r]+", x)) for x in each]
        gone = []
        for n, s in enumerate(sets):
            if s:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    gone.append(n)
                seen.append(s)
        wanted[i] = (len(each), sum(not s for s in sets), gone)
    assert got == wanted
    left = lines.drop_lines(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 91 in texts and 90 in texts and 60 not in texts
    for i, t in texts.items():
        if t:
            whole = next(r[1] for r in rows if r[0] == i).split("\n")
            assert t == "\n".join(x for n, x in enumerate(whole) if n not in wanted[i][2])
    assert lines.line_report(docs(spark, [])).collect() == []


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus() + [(200, "ÄB cd ef", "s", "en"), (201, "a", "s", "en"), (202, "A", "s", "en")]
    fp = {(i, t): brute_fingerprint(t) for i, t, *_ in rows}
    keys = list(fp)
    comp = {k: k for k in keys}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in keys:
        for b in keys:
            if bin(fp[a] ^ fp[b]).count("1") <= 2:
                comp[find(a)] = find(b)
    least: dict = {}
    for k in keys:
        if k[0] is not None:
            least[find(k)] = min(k[0], least.get(find(k), 1 << 62))
    wanted = sorted((k[0] if k[0] is not None else -1, fp[k], least.get(find(k))) for i, t, *_ in rows for k in [(i, t)])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == wanted
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_fingerprint_balls(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(8)} | {0, 1, 1 << 63, 2**64 - 1}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    wanted = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= 2}
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == wanted


def test_mix(spark):
    rows = corpus() + [(300 + i, "w " * 40, "big", "en") for i in range(40)]
    d = docs(spark, rows).select("*", mixing.n_words(F.col("text")).alias("n")).select("doc_id", "source", F.col("n").alias("size"))
    got = mixing.taken(d).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s) + [None]
    target, free = {}, set(names)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest = sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= 3 * size[s]
        free -= over
    took = dict.fromkeys(names, 0)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= 1 for s in names)
    again = mixing.taken(d.repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    _, schedule = mixing.mix(d)
    blocks = schedule.groupBy("slot").agg(F.countDistinct("sid", "block").alias("n"), F.sum("length").alias("words")).collect()
    assert {r["n"] for r in blocks} == {1}
    assert mixing.taken(d.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.taken(d.where("size = 0")).collect()] == [0] * 3
    whole = docs(spark, rows)
    assert mixing.repeat(whole).columns == whole.columns


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for cap, n in ((10, 50), (2048, 5000), (2048, 1)):
        x = rng.integers(1, cap + 1, n)
        b, o = packing.best_two_fit(x, cap)
        used: dict = {}
        for i in np.argsort(o, kind="stable"):
            assert used.get(b[i], 0) == o[i]
            used[b[i]] = used.get(b[i], 0) + x[i]
        assert max(used.values()) <= cap
        assert len(used) <= np.ceil(x.sum() / cap) * 1.25 + 1
    b, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # 6 and 3 leave 1; 2 and 2 for the 3 leave none
    assert sorted(np.bincount(b, weights=[6, 3, 2, 2])) == [3, 10]


def test_pack(spark):
    path = packing.vocabulary()
    rows = corpus() + [(400, "a<|endoftext|>b", "s", "en"), (401, "  two  spaces \n x ", "s", "en")]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        mine = mine[::2] if i == 94 else mine
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert all(r["length"] == 2048 for r in mine[1:])
    used: dict = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    assert len(used) <= sum(used.values()) / 2048 * 1.02 + 1
    assert packing.pack_documents(docs(spark, []), path).collect() == []


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "bob b", "yes"), (1, 2, "bob b", "yes"), (1, 3, None, None), (1, 4, "bob_b", "no"), (1, 5, "Анна", "да"), (1, 6, "Иван", "нет"), (1, None, "user", "first"), (2, 0, "system", "alone"), (None, 0, "user", "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, head string, start int")
    views: dict = {}
    for r in chat.rotate(d).collect():
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "user"), (1, "bob b"), (1, "bob_b"), (1, "Анна"), (1, "Иван"), (1, "unknown"), (None, "user")}
    for (_, who), turns in views.items():
        turns.sort(key=lambda r: r["start"])
        whole = "".join(r["piece"] for r in turns)
        assert [r["start"] for r in turns] == [sum(len(x["piece"]) for x in turns[:i]) for i in range(len(turns))]
        for r in turns:
            assert (r["mask_start"] is not None) == (r["speaker"] == who and "system\n" not in r["piece"])
            if r["mask_start"] is not None:
                assert whole[: r["mask_start"]].endswith("<|im_start|>assistant\n") and whole[r["mask_start"] : r["mask_end"]].endswith("<|im_end|>\n")
    mine = sorted(views[1, "user"], key=lambda r: r["start"])
    assert mine[0]["piece"] == "<|im_start|>assistant\nfirst<|im_end|>\n" and len(mine) == 9
    assert mine[2]["piece"] == "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
    assert mine[3]["piece"] == "<|im_start|>user name=bob%20b\nyes<|im_end|>\n"
    assert [r["piece"] for r in views[1, "Анна"] if r["mask_start"] is not None] == ["<|im_start|>assistant\nда<|im_end|>\n"]
    assert chat.rotate(d.limit(0)).collect() == []
    many = spark.createDataFrame([(1, i, f"p{i % 3}", "x" * (200_000 if i == 7 else i % 5)) for i in range(2000)], "conv_id long, turn long, role string, text string")
    for who in ("p0", "p1", "p2"):
        view = sorted(chat.rotate(many).where(F.col("perspective") == who).collect(), key=lambda r: r["turn"])
        assert [r["start"] for r in view] == [0, *np.cumsum([len(r["piece"]) for r in view])[:-1]]


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    rows = [(1, "MIT LICENCE!\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " , "), "s", "en"), (2, "text\nreleased under the MIT Licence\nmore", "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"), (5, mit + " not quite", "s", "en"), (1, mit, "s", "en"), (6, "© 2020", "s", "en")]
    got = sorted(((r["doc_id"], r["licence"], tuple(r["line_licences"]), r["digest"] is None) for r in licences.scan(docs(spark, rows), licences.known(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", (), False), (1, "MIT", (), False), (2, None, ("MIT",), False), (3, None, (), True), (4, None, (), True), (5, None, (), False), (6, None, (), True)], key=str)
    assert licences.scan(docs(spark, []), licences.known(spark)).collect() == []


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["banara", "ranab", "anab", "bar"], "ee": ["tekele", "leket", "ekel", "tek"], "oo": ["mosoho", "homos", "osom", "som"]}
    rows = [(i, prose(rng, rng.randint(5, 120), words[lang]), "s", lang) for i, lang in enumerate(sorted(words) * 60)]
    rows += [(500, None, "s", "aa"), (501, "", "s", None), (502, "12 34 !", "s", "ee"), (503, " ".join(["banara"] * 50 + ["tekele"] * 20), "s", None), (None, "som osom", "s", "oo"), (504, "x" * 100_000 + " tekele", "s", "ee")]
    got = {r["doc_id"]: r for r in langid.language(docs(spark, rows), 50).collect()}
    out = [(got[i]["lang_pred"], lang) for i, _, _, lang in rows[:180] if got[i]["held_out"]]
    assert len(out) > 20 and sum(a == b for a, b in out) / len(out) >= 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert got[503]["lang_pred"] == "aa" and 0.5 < got[503]["score"] < 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.language(docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language(docs(spark, [])).collect() == []
    left = langid.speak(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert {500, 501, 502}.isdisjoint({r["doc_id"] for r in left.collect()})


def test_forward_backward():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 1, 5, 4])
    e, step, start = rng.standard_normal((14, 3)), rng.standard_normal((3, 3)), rng.standard_normal((5, 3))
    m, p = langid.forward_backward(e, lengths, step, start, pairs=True)
    two, at = np.zeros((3, 3)), 0
    for c, n in enumerate(lengths):
        z, one, steps = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in product(range(3), repeat=int(n)) if n else []:
            w = np.exp(start[c, y[0]] + sum(e[at + i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
            z += w
            for i in range(n):
                one[i, y[i]] += w
            for i in range(n - 1):
                steps[y[i], y[i + 1]] += w
        if n:
            assert np.allclose(m[at : at + n], one / z, atol=1e-5)
            two += steps / z
        at += n
    assert np.allclose(p, two, atol=1e-4)


PAGE = "<html><head><title>no</title></head><body><header>Top</header><nav><ul><li>Menu</ul></nav><div id=main><div class='tagline'>We are best</div><h1>{0}</h1><p>{1} &amp; {2}<p>end &#8212; {0}</div><div class='comments'><p>bad</div><form>x</form><footer>foot</footer><script>var x='<p>no</p>';</script></body></html>"


def test_pages(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(f"Title{i}", prose(rng, 9), f"word{i}")) for i in range(8)]
    rows += [(20, "http://h0.example.com/x", None), (21, None, "<p>a<br>b\n <b>c</b>"), (22, "nonsense", ""), (23, "http://lone.example.com/", PAGE.format("T", "b", "c")), (24, "http://h1.example.com/n", "<div>" * 3000 + "deep")]
    d = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, wrapper string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(d).collect()}
    for i in range(8):
        lines = got[i][0].split("\n")
        assert lines[0] == f"Title{i}" and lines[1].endswith(f"& word{i}") and lines[2] == f"end — Title{i}" and len(lines) == 3
        assert got[i][1] == len(got[i][0])
    assert got[20] == ("", 0) and got[21] == ("a b c", 5) and got[22] == ("", 0)
    assert got[23][0].split("\n")[0] == "We are best"
    assert got[24][0] == "deep"
    assert html_extract.main_text(d.limit(0)).collect() == []
    same = spark.createDataFrame([(i, "http://c.example.com/", PAGE.format("T", "b", "c"), None, None) for i in range(5)], d.schema)
    assert len({r["text"] for r in html_extract.main_text(same).collect()}) == 1
    assert "T" in html_extract.main_text(same).first()["text"].split("\n")
