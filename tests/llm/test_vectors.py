"""Operators on vectors, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import ann, neardup_vec
from hushlake.llm.common import components, union_find

SCHEMA = "vec_id long, embedding array<float>, label int, v string, tile int"


def fixture(seed=3, n=300, width=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, width))
    rows = []
    for i in range(n):
        x = base[i % 40] + rng.standard_normal(width) * rng.choice([0.0, 0.05, 0.25])
        rows.append((i, [float(np.float32(y)) for y in x], i % 3 if i % 17 else None, "x", 1))
    bad = [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1)]
    rows += [(n + i, b, 0, None, None) for i, b in enumerate(bad)]
    rows += [(n + 10 + i, rows[0][1], rows[1][2], None, None) for i in range(30)]  # copies
    rows += [(n + 50, [1.0, 2.0], 0, None, None), (n + 51, [2.0, 4.0], 0, None, None)]  # another length
    return rows


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("tile", [4096, 16])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup_vec, "TILE", tile)
    rows = fixture()
    links = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[2] is not None and a[2] == b[2] and sound(a[1]) and sound(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93]
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    node, root = union_find(*map(np.array, zip(*links)))
    first = dict(zip(node.tolist(), root.tolist()))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vec.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n, first.get(i, i), first.get(i, i) == i) for i, n in count.items()}


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup_vec.near_duplicates(none).collect() == []
    assert ann.search(none, F.col("vec_id") % 2 == 0).collect() == []
    bad = spark.createDataFrame([(1, None, 0, None, None), (2, [0.0], None, None, None)], SCHEMA)
    assert sorted(tuple(r) for r in neardup_vec.near_duplicates(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ann.search(bad, F.col("vec_id") % 2 == 0).collect() == []


@pytest.mark.parametrize("per_list", [1024, 40])
def test_search(spark, monkeypatch, per_list):
    monkeypatch.setattr(ann, "PER_LIST", per_list)
    monkeypatch.setattr(ann, "CHUNK", 25)
    rows = fixture(4, 400)
    d = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in ann.search(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = wanted = 0
    for q, v, *_ in rows:
        if q % 20 or not sound(v):
            continue
        near = sorted((math.dist(v, w), i) for i, w, *_ in rows if i != q and sound(w) and len(w) == len(v))[:10]
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [(round(s, 12), i) for _, i, s in mine] == sorted((round(s, 12), i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
        wanted += len(near)
    assert set(got) == {r[0] for r in rows if r[0] % 20 == 0 and sound(r[1])}
    assert hits / wanted >= (0.9 if per_list < 1024 else 1.0)


@pytest.mark.parametrize("local", [400_000, 10])
def test_components(spark, local):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 220), rng.integers(0, 300, 220)
    a, b = np.concatenate([a, np.arange(1000, 1060)]), np.concatenate([b, np.arange(1001, 1061)])  # and a long path
    node, root = union_find(a[a != b], b[a != b])
    pairs = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    groups: dict = {}
    for r in components(pairs, local).collect():
        groups.setdefault(r["component"], set()).add(r["id"])
    wanted: dict = {}
    for n, r in zip(node.tolist(), root.tolist()):
        wanted.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
