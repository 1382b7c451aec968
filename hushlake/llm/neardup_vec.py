"""Embedding near-duplicates by comparison of tiles in the order of principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, union_find
from .vectors import matrix, sound

#: Vectors in a tile, and leading components that are summed up before the bound is looked at.
TILE, BLOCK = 4096, 16
#: Vectors that the components are fitted on. A bad fit costs time, never a link.
SAMPLE = 4096
#: Leading components whose medians part the vectors into tiles, as many as a label's size asks for; and those whose ranges rule pairs of tiles out.
BITS, LEAD = 16, 8


def axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal components of a bounded sample of unit vectors, as columns, the leading first; and their medians."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    x = unit(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), width))
    _, turn = np.linalg.eigh(x.T @ x)
    turn = np.ascontiguousarray(turn[:, ::-1])
    return turn, np.median(x @ turn, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Rows of either side that are compared at once, and pairs that are verified at once: they bound the memory.
STRIPE, MANY = 1024, 1 << 16


def _compare(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b, turned unit vectors, whose cosine may reach the threshold.

    Leading components are summed up block by block. What the rest can add is bounded by the
    product of the norms of the rests; a pair that can't get there is left out of further blocks.
    """
    width, slack = a.shape[1], threshold - 1e-9
    rest = lambda x, k: np.sqrt((x[:, k:] ** 2).sum(axis=1))
    k = min(BLOCK, width)
    part = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(part + rest(a, k)[:, None] * rest(b, k) >= slack)
    part = part[i, j]
    while k < width and len(i):
        to = min(k + BLOCK, width)
        part = part + np.einsum("ij,ij->i", a[i, k:to], b[j, k:to])
        k = to
        live = part + rest(a, k)[i] * rest(b, k)[j] >= slack
        i, j, part = i[live], j[live], part[live]
    return i, j


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y, as they are."""
    sx, sy = np.abs(x).max(axis=1, keepdims=True), np.abs(y).max(axis=1, keepdims=True)
    x, y = x / sx, y / sy
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def tiles(vectors: DataFrame, turn: np.ndarray, middle: np.ndarray) -> DataFrame:
    """(vec_id, label, v, lead, tile): vectors of a label on the same sides of the leading medians, as many medians as give tiles of TILE vectors; larger ones are dealt out by hash."""
    width = len(turn)
    bits, lead = min(BITS, width), min(LEAD, width)

    def run(batches):
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b["v"], width)) @ turn
                code = ((u[:, :bits] > middle[:bits]) << np.arange(bits)[::-1]).sum(axis=1)
                head = pa.ListArray.from_arrays(pa.array(np.arange(0, len(u) * lead + 1, lead, dtype=np.int32)), pa.array(u[:, :lead].ravel()))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], head, pa.array(code.astype(np.int64))], ["vec_id", "label", "v", "lead", "code"])

    dealt = cut(vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<double>, lead array<double>, code long"))
    depth = F.least(F.lit(bits), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*") / TILE))).cast("int"))
    depth = dealt.groupBy("label").agg(depth.alias("depth"))
    dealt = dealt.join(depth, "label").withColumn("cell", F.expr(f"shiftright(code, {bits} - depth)"))
    parts = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / (2 * TILE)).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return dealt.join(parts, ["label", "cell"]).select("vec_id", "label", "v", "lead", (F.col("cell") * (1 << 32) + part).alias("tile"))


def tile_pairs(tiled: DataFrame, threshold: float, lead: int) -> DataFrame:
    """(label, p, q), p <= q: the pairs of tiles whose ranges of the leading components are near enough for a link."""
    wide = tiled.groupBy("label", "tile").agg(*[f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(lead) for n, f in (("lo", F.min), ("hi", F.max))])
    p = wide.select(F.col("label").alias("own"), *[F.col(c).alias(f"p_{c}") for c in wide.columns if c != "label"])
    q = wide.select("label", *[F.col(c).alias(f"q_{c}") for c in wide.columns if c != "label"])
    far = F.lit(0.0)
    for k in range(lead):
        gap = F.greatest(F.col(f"p_lo{k}") - F.col(f"q_hi{k}"), F.col(f"q_lo{k}") - F.col(f"p_hi{k}"), F.lit(0.0))
        far = far + gap * gap
    near = (F.col("own") == F.col("label")) & (F.col("p_tile") <= F.col("q_tile")) & (far <= 2 - 2 * threshold + 1e-6)
    return p.join(q, near).select("label", F.col("p_tile").alias("p"), F.col("q_tile").alias("q"))


def linked(vectors: DataFrame, threshold: float, width: int) -> DataFrame:
    """(kind, a, b): for kind 0 vector a has b more links; for kind 1 a and b are of one component.

    A pair of tiles gives each of its vectors' number of links and a spanning forest, never all
    links, so that a large group of near copies gives no more rows than it has vectors.
    """
    turn, middle = axes(vectors, width)
    t = tiles(vectors, turn, middle)
    pairs = cut(tile_pairs(t, threshold, min(LEAD, width)))
    own = t.select("label", "tile", "vec_id", "v")
    side = lambda c, n: own.join(pairs.select("label", F.col(c).alias("tile"), "p", "q"), ["label", "tile"]).select("label", "p", "q", F.lit(n).alias("side"), "vec_id", "v")
    both = side("p", 0).union(side("q", 1).where("p <> q"))

    def run(table: pa.Table) -> pa.Table:
        s, ids = table["side"].to_numpy(), table["vec_id"].to_numpy()
        v = matrix(table["v"], width)
        u = unit(v) @ turn
        a = np.flatnonzero(s == 0)
        alone = len(a) == len(s)
        b = a if alone else np.flatnonzero(s == 1)
        counts = np.zeros(len(ids), np.int64)
        trees = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x in range(0, len(a), STRIPE):
            for y in range(x if alone else 0, len(b), STRIPE):
                ai, bj = a[x : x + STRIPE], b[y : y + STRIPE]
                i, j = _compare(u[ai], u[bj], threshold)
                i, j = ai[i], bj[j]
                if alone and x == y:
                    i, j = i[i < j], j[i < j]
                ok = np.concatenate([np.zeros(0, bool), *(_cosine(v[i[z : z + MANY]], v[j[z : z + MANY]]) >= threshold for z in range(0, len(i), MANY))])
                i, j = i[ok], j[ok]
                counts += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                trees.append(union_find(i, j))
        node, root = union_find(*map(np.concatenate, zip(*trees)))
        has, tree = np.flatnonzero(counts), node != root
        kind = np.repeat(np.array([0, 1], np.int32), [len(has), int(tree.sum())])
        return pa.table({"kind": kind, "a": np.concatenate([ids[has], ids[node[tree]]]), "b": np.concatenate([counts[has], ids[root[tree]]])})

    return both.groupBy("label", "p", "q").applyInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding, label).

    Vectors of one label, not null, are linked if their cosine, in double precision, is at least
    ``threshold``. Null, zero and broken vectors, and those without a label, have no links; neither
    are vectors of different lengths linked. Copies count as links each. Ids are taken to be unique:
    rows of one id are one node, whose links are added up. A null id gets no component.
    """
    good = sound(vectors).where("label is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    found = None
    for r in good.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # lengths of vectors, one as a rule
        part = linked(good.where(F.size("v") == r["n"]), threshold, r["n"])
        found = part if found is None else found.union(part)
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if found is None:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found)
    n = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).withColumnRenamed("a", "id")
    c = cut(components(found.where("kind = 1").select("a", "b")))
    least = c.groupBy("component").agg(F.min("id").alias("least"))
    c = c.join(least, "component").select(F.col("id").alias("cid"), "least")
    out = all_ids.join(n, all_ids["vec_id"] == n["id"], "left").join(c, F.col("vec_id") == F.col("cid"), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
