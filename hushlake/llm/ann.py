"""Approximate nearest neighbours by an adaptive scan of dimensions in probed lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, sound

#: Vectors that the lists' centres are fitted on, and the most lists. Every vector is indexed.
SAMPLE, LISTS = 16_384, 4096
#: Vectors a list has about, and at most in one task; queries at most in one task.
PER_LIST, CHUNK, QUERIES = 1024, 8192, 2048
#: Dimensions in a block. After each block a candidate is tested.
BLOCK = 16
#: Of the hypothesis test: a candidate is given up if its partial distance is beyond what a nearer one has but once in thousands.
DOUBT = 2.1
#: Queries whose true neighbours, by brute force, tell how many lists must be probed, and the recall that this aims at.
PROBE_QUERIES, AIM = 256, 0.97


def rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)))


def centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means of the rows of x."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n_in = np.bincount(near, minlength=len(c))
        c[n_in > 0] = sums[n_in > 0] / n_in[n_in > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of c for each row of x, the nearest first."""
    out = np.empty((len(x), k), np.int32)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 1024):
        d = half - x[i : i + 1024] @ c.T
        if k == 1:
            out[i : i + 1024, 0] = d.argmin(axis=1)
        else:
            out[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows, on the original vectors in double precision."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
    big = ~np.isfinite(d)
    if big.any():
        s = np.abs(x[big] - q).max(axis=1)
        d[big] = s * np.sqrt((((x[big] - q) / s[:, None]) ** 2).sum(axis=1))
    return d


def scan(q: np.ndarray, qr: np.ndarray, bound: np.ndarray, blocks: list[np.ndarray], x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of the k nearest candidates, ties to the smaller id.

    ``blocks`` are the candidates' rotated vectors, column block by column block. After a block a
    candidate is given up if its partial distance, scaled up to all dimensions, is beyond ``bound``
    (squared, of the query) by more than chance allows.
    """
    width = qr.shape[1]
    out = []
    first = ((qr[:, None, : blocks[0].shape[1]] - blocks[0][None]) ** 2).sum(axis=2) if len(qr) * blocks[0].size < 1 << 22 else None
    for i in range(len(q)):
        d = first[i] if first is not None else ((blocks[0] - qr[i, : blocks[0].shape[1]]) ** 2).sum(axis=1)
        at = blocks[0].shape[1]
        live = np.flatnonzero(ids != own[i])
        d = d[live]
        for b in blocks[1:]:
            fit = d <= bound[i] * (at / width) * (1 + DOUBT / math.sqrt(at)) ** 2
            live, d = live[fit], d[fit]
            if not len(live):
                break
            d = d + ((b[live] - qr[i, at : at + b.shape[1]]) ** 2).sum(axis=1)
            at += b.shape[1]
        if len(live) > 4 * k and np.isfinite(bound[i]):
            live = live[d <= bound[i] * (1 + 1e-9) + 1e-12]
        true = distances(q[i], x[live])
        if len(live) > k:
            part = np.argpartition(true, k - 1)
            fit = true <= true[part[k - 1]]
            live, true = live[fit], true[fit]
        order = np.lexsort((ids[live], true))[:k]
        out.append((ids[live[order]], true[order]))
    return out


def _probes(centre: np.ndarray, turn: np.ndarray, sample_q: np.ndarray, near_lists: np.ndarray) -> int:
    """How many lists, the nearest first, hold the share AIM of the true neighbours: near_lists are their lists, by query."""
    order = nearest(sample_q @ turn, centre, len(centre))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centre), dtype=np.int32)[None], axis=1)
    ranks = np.sort(np.concatenate([rank[i, lists] for i, lists in enumerate(near_lists)]) if len(near_lists) else np.zeros(1, np.int32))
    return int(ranks[min(len(ranks) - 1, math.ceil(AIM * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds its k nearest other rows found, by Euclidean distance.

    All vectors are indexed in lists about k-means centres of a bounded sample. How many lists a query
    probes is measured: as many as hold the neighbours that a bounded sample of queries has in all
    vectors, and for each query further ones until it has k candidates or all. Null, zero and broken vectors and null ids take no part; vectors meet those of their length.
    Rows of one id are one candidate each, but never their own query's.
    """
    good = sound(vectors).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(queries, F.lit(False)).alias("asks"))
    good = good.withColumn("width", F.size("v"))
    out = None
    for r in good.groupBy("width").count().orderBy("width").collect():  # lengths of vectors, one as a rule
        part = _search(good.where(F.col("width") == r["width"]).drop("width"), r["width"], r["count"], k)
        out = part if out is None else out.union(part)
    if out is None:
        none = vectors.sparkSession.range(0)
        return none.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    return out


def _search(good: DataFrame, width: int, n: int, k: int) -> DataFrame:
    spark = good.sparkSession
    turn = rotation(width)
    by_hash = lambda d, m: d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).select("vec_id", "v").collect()
    fit = np.array([r["v"] for r in by_hash(good, SAMPLE)]).reshape(-1, width) @ turn
    centre = centres(fit, max(1, min(LISTS, n // PER_LIST, len(fit))))

    asked = by_hash(good.where("asks"), PROBE_QUERIES)
    if not asked:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    q0, id0 = np.array([r["v"] for r in asked]).reshape(-1, width), np.array([r["vec_id"] for r in asked])

    def index(batches):
        """Every vector's list; for kind 1 the true nearest of the sampled queries within the batch."""
        for b in batches:
            if b.num_rows:
                x = matrix(b["v"], width)
                lists = nearest(x @ turn, centre, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], b["asks"], pa.array(lists)], ["vec_id", "v", "asks", "list"])

    indexed = cut(good.select("vec_id", "v", "asks").mapInArrow(index, "vec_id long, v array<double>, asks boolean, list int"))

    def brute(batches):
        for b in batches:
            x, ids, lists = matrix(b["v"], width), b["vec_id"].to_numpy(), b["list"].to_numpy()
            m = min(k, len(x))
            d = (x * x).sum(axis=1) - 2 * (q0 @ x.T)
            d[id0[:, None] == ids] = np.inf
            if m:
                top = np.argpartition(d, m - 1, axis=1)[:, :m]
                true = np.take_along_axis(d, top, axis=1)
                yield pa.RecordBatch.from_pydict({"q": np.repeat(np.arange(len(q0), dtype=np.int32), m), "d": true.ravel(), "list": lists[top].ravel()})

    best = indexed.select("vec_id", "v", "list").mapInArrow(brute, "q int, d double, list int")
    w = Window.partitionBy("q").orderBy("d", "list")
    best = best.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("d") < float("inf"))).select("q", "list").collect()
    near: list[list[int]] = [[] for _ in asked]
    for r in best:
        near[r["q"]].append(r["list"])
    probes = _probes(centre, turn, q0, [np.array(x, np.int64) for x in near])

    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    held = indexed.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v")

    rows_in = np.zeros(len(centre), np.int64)
    for r in indexed.groupBy("list").count().collect():  # LISTS at most
        rows_in[r["list"]] = r["count"]

    def ask(batches):
        """A query's lists: as many as are probed, and further ones until they hold k rows besides its own id's."""
        for b in batches:
            if b.num_rows:
                x = matrix(b["v"], width) @ turn
                lists = list(nearest(x, centre, min(probes, len(centre))))
                need = k + b["own"].to_numpy()
                few = np.flatnonzero([rows_in[y].sum() < n for y, n in zip(lists, need)])
                for i, y in zip(few.tolist(), nearest(x[few], centre, len(centre)) if len(few) else []):
                    lists[i] = y[: max(len(lists[i]), int(np.searchsorted(np.cumsum(rows_in[y]), need[i])) + 1)]
                m = [len(y) for y in lists]
                at = pa.array(np.repeat(np.arange(len(m)), m))
                place = np.concatenate([np.arange(n, dtype=np.int32) for n in m])
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(at), b["v"].take(at), pa.array(np.concatenate(lists)), pa.array(place)], ["query_id", "q", "list", "place"])

    often = indexed.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1").withColumnRenamed("vec_id", "id")
    asks = good.where("asks").select("vec_id", "v")
    asks = asks.join(often, asks["vec_id"] == often["id"], "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    asks = asks.mapInArrow(ask, "query_id long, q array<double>, list int, place int")
    asks = cut(asks)

    def meet(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
        """The k nearest of each wanted query in each of its lists' chunks; ``bound`` is what its neighbours must beat, squared."""
        per = wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        there = candidates.join(per, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        here = wanted.join(per, "list").join(sizes, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        here = here.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        c = there.select("list", "chunk", "block", "vec_id", "v").groupBy("list", "chunk", "block")
        a = here.select("list", "chunk", "block", "query_id", "q", "bound").groupBy("list", "chunk", "block")

        def run(a: pa.Table, c: pa.Table) -> pa.Table:
            got: list = []
            if a.num_rows and c.num_rows:
                x, ids = matrix(c["v"], width), c["vec_id"].to_numpy()
                q = matrix(a["q"], width)
                turned = x @ turn
                parts = [np.ascontiguousarray(turned[:, i : i + BLOCK]) for i in range(0, width, BLOCK)]
                got = scan(q, q @ turn, a["bound"].to_numpy(), parts, x, ids, a["query_id"].to_numpy(), k)
            empty = [(np.zeros(0, np.int64), np.zeros(0))]
            i, d = map(np.concatenate, zip(*(got or empty)))
            who = np.repeat(a["query_id"].to_numpy(), [len(x) for x, _ in got]) if got else i
            return pa.table({"query_id": who.astype(np.int64), "vec_id": i.astype(np.int64), "score": d.astype(np.float64)})

        return a.cogroup(c).applyInArrow(run, "query_id long, vec_id long, score double")

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    home = cut(top(meet(held, asks.where("place = 0").withColumn("bound", F.lit(float("inf"))))))
    reach = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score") * F.max("score")).alias("bound"))
    rest = asks.where("place > 0").join(reach, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = home.select("query_id", "vec_id", "score").union(meet(held, rest))
    return top(found).select("query_id", "rank", "vec_id", "score")
