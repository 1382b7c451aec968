"""The registered queries over whole tables: against their SQL, or against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import both
from pyspark.sql import functions as F

from hushlake.llm.chat import SQL, rotate
from hushlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def table(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got, wanted = both(spark, QUERIES[name], ORACLES[name], SF)
    assert got == wanted and got


def groups(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    docs = table("documents", "doc_id, text")
    fp = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    wanted = groups(ids, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", wanted[i]) for i in ids} and len(set(wanted.values())) < len(ids)


def vectors() -> tuple[list[int], np.ndarray, list]:
    column = next(c for c, t, *_ in duckdb.sql(f"describe select * from '{SF}/embeddings.parquet'").fetchall() if "[]" in t)
    rows = table("embeddings", f"vec_id, {column}, label")
    fit = [(i, v, x) for i, v, x in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    return [i for i, _, _ in fit], np.array([v for _, v, _ in fit], dtype=np.float64), [x for _, _, x in fit]


def test_links_against_brute_force(spark):
    ids, v, labels = vectors()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    linked = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1))) if labels[a] is not None and labels[a] == labels[b]]
    n = defaultdict(int)
    for pair in linked:
        for i in pair:
            n[i] += 1
    every = [i for (i,) in table("embeddings", "vec_id")]
    wanted = groups(every, linked)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op3_tiles"](spark, SF).collect()}
    assert got == {i: (n[i], wanted[i], wanted[i] == i) for i in every}


def test_neighbours_against_brute_force(spark):
    ids, v, _ = vectors()
    found = defaultdict(list)
    for r in QUERIES["op10_ann"](spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert set(found) == {i for i in ids if i % 100 == 0}
    for q, rows in found.items():
        d = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(axis=1))
        best = sorted((x, i) for x, i in zip(d, ids) if i != q)[:10]
        assert [r for r, _, _ in rows] == list(range(1, len(best) + 1))
        assert all(abs(score - d[ids.index(i)]) < 1e-9 for _, i, score in rows)
        hits, total = hits + len({i for _, i, _ in rows} & {i for _, i in best}), total + len(best)
    assert hits >= 0.9 * total > 0


def test_a_third_of_all_turns_in_one_dialogue_and_odd_numbers(spark, tmp_path):
    """Null, negative, far and repeated turn numbers, many turns, a long text."""
    turns = [(1, t, r, x) for t in (None, -300, -1, 0, 255, 256, 1 << 40) for r, x in (("a", "x"), ("b", None), (None, "<|im_end|>"), ("system", ""))]
    turns += [(2, i, f"s{i % 3}", "w" * (i % 7)) for i in range(1500)] + [(3, 1, "a", "long " * 200_000), (3, 1, "a", "long " * 200_000), (None, 1, "a", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = sorted(map(repr, con.sql(SQL).fetchall()))
    got = rotate(spark.read.parquet(str(tmp_path / "conversations.parquet")))
    assert sorted(repr(tuple(r)) for r in got.collect()) == wanted
