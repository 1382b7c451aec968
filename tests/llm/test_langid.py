"""Languages whose labelled texts are all short, or one word without spaces, beside languages of long texts."""

from __future__ import annotations

import random

from test_text import docs

from hushlake.llm import langid

WORDS = {"aa": ["banara", "ranab", "anab", "bar"], "ee": ["tekele", "leket", "ekel", "tek"], "oo": ["mosoho", "homos", "osom", "som"]}


def texts(rng, lang):
    if lang == "uu":  # no spaces
        return "".join(rng.choice(["kulu", "lukuk", "ulul"]) for _ in range(6))
    return " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 20) if lang == "oo" else 150))


def test_short_texts_are_learned():
    rng = random.Random(4)
    langs = ["aa", "ee", "oo", "uu"] * 30
    field = langid.fit([texts(rng, x) for x in langs], langs)
    got = langid.Labeller(field)([texts(rng, x) for x in langs])
    assert sum(a == b for (a, _), b in zip(got, langs)) >= 0.98 * len(langs)


def test_speak_keeps_short_languages(spark):
    rng = random.Random(5)
    rows = [(i, texts(rng, lang), "s", lang) for i, lang in enumerate(["aa", "ee", "oo", "uu"] * 20)]
    left = {r["doc_id"] for r in langid.speak(docs(spark, rows)).collect()}
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.language(docs(spark, rows)).collect()}
    assert len(left) >= 78 and sum(pred[i] == lang for i, _, _, lang in rows) >= 78


def test_code_switched_words_are_labelled_across_chains():
    rng = random.Random(6)
    langs = ["aa", "ee"] * 60
    field = langid.fit([texts(rng, x) for x in langs], langs)
    label = langid.Labeller(field)
    say = lambda lang, n: [rng.choice(WORDS[lang]) for _ in range(n)]
    words = say("aa", 70) + ["12"] + say("ee", 200) + say("aa", 33)
    got = label.words(" ".join(words))
    wanted = ["aa"] * 70 + [None] + ["ee"] * 200 + ["aa"] * 33
    assert [w for w, _ in got] == words
    assert sum(a == b for (_, a), b in zip(got, wanted)) >= 0.98 * len(words)
    assert field.start.any() and field.step[0, 0] > field.step[0, 1]
    # a word unlike any language takes its neighbours', also where a chain of the fit would end
    for at in (1, 63, 64, 65, 127, 128):
        w = say("ee", 192)
        w[at] = "xxxx"
        assert label.words(" ".join(w))[at][1] == "ee"
    assert label.words("") == [] and label([None, "", "12 !"]) == [("und", 0.0)] * 3


def test_features_of_all_words_at_once():
    words = ["Word", "word", "(word)", "12", "", "é", "aé9b", "x" * 1000, "word"]
    flat, owner = langid.features(words)
    own = lambda i: sorted(flat[owner == i].tolist())
    assert own(0) == own(1) == own(2) == own(8) and not own(3) and not own(4) and len(own(5)) == 2 + 1 + 7 + 1
    for i, w in enumerate(words):
        assert own(i) == sorted(langid.features([w])[0].tolist())
    assert len(langid.features([])[0]) == 0
