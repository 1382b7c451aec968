"""The field of the languages is fitted in a worker: the driver's memory has no part in it."""

import os

import numpy as np

from hushlake.llm import langid


def test_the_driver_does_not_fit(spark, monkeypatch):
    k = langid.BUCKETS
    monkeypatch.setattr(langid, "fit", lambda texts, langs: langid.Field([str(os.getpid())], np.zeros((k, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)))
    rows = [(i, "some words here", "en") for i in range(30)]
    field = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(field.labels) == 1 and field.labels != [str(os.getpid())]
    assert field.weights.shape == (k, 1) and field.step.shape == (1, 1) and field.start.shape == (1,)


def test_the_field_is_the_same_and_may_be_empty(spark):
    rows = [(i, f"{'der die das' if i % 2 else 'the of and'} {i}", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = sorted((r["lang"], r["doc_id"], r["text"]) for r in docs.where(~langid.held_out("doc_id")).collect())
    field, want = langid.train(docs), langid.fit([t for _, _, t in known], [x for x, _, _ in known])
    assert field.labels == want.labels == ["de", "en"]
    assert all((getattr(field, c) == getattr(want, c)).all() for c in ("weights", "step", "start"))
    assert langid.train(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang = 'x'")).labels == []
    assert langid.Labeller(langid.train(docs.where("false")))(["a", None]) == [("und", 0.0)] * 2
