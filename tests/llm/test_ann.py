"""Queries whose nearest lists are tiny find as many rows as there are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hushlake.llm import ann


def test_tiny_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 20)
    monkeypatch.setattr(ann, "_probes", lambda *a: 1)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 6)) + 20 * (np.arange(120) % 3)[:, None]
    x[::20] += 500 * rng.standard_normal((6, 6))  # far from all
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, (x[20] + i / 100).tolist()) for i in range(15)]  # one id of many rows
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(d, F.col("vec_id") % 5 == 0).select("query_id", "rank").distinct().collect():
        got.setdefault(r["query_id"], set()).add(r["rank"])
    assert got == {i: set(range(1, 11)) for i in range(0, 120, 5)}
    few = ann.search(d.where("vec_id < 6"), F.col("vec_id") == 0)
    assert few.select("rank").distinct().count() == 5
