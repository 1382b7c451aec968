"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, keep_first, tidy

#: Shingles whose bits are counted at once: bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash (as a signed long) of the word shingles of a whole text; 0 if it has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    if n == 1:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        whole = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
        hashes = [digest(whole[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row per document, null text like an empty one."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b["text"]], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _index(fps: DataFrame) -> DataFrame:
    """The two tables of the index in one: (key, fp), the key being a half and its place."""
    half = lambda i: F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))
    return fps.select("fp", F.posexplode(F.array(half(0), half(1))).alias("seg", "half"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fps`` that differ in at most two bits.

    Two bits fall on two halves so that one half has at most one of them. Each half's Hamming
    ball of radius one is enumerated and looked up among the halves. A difference of one bit is
    found from the side that has 0 there, so only those bits are set: 17 probes of the mean half.
    """
    t = _index(fps)
    flip = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.call_function("getbit", F.col("half"), i) == 0, F.col("half").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    ball = F.filter(F.concat(F.array("half"), flip), lambda x: x.isNotNull())
    p = t.select(F.col("fp").alias("a"), "seg", "half", F.explode(ball).alias("probe"))
    key = lambda c: (F.col("seg") * F.lit(1 << 32) + F.col(c)).alias("key")
    p = p.select(key("probe"), F.col("a"), (F.col("probe") == F.col("half")).alias("same"))
    t = t.select(key("half"), F.col("fp").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))
    return p.join(t, (p["key"] == t["key"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the documents linked to it, over any number of links.

    Documents of one fingerprint are one class, so copies are never expanded into pairs. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with the same doc_id are
    all kept; a null doc_id is never the smallest unless its component has no other.
    """
    d = cut(fingerprints(docs))
    classes = cut(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    c = components(links(classes.select("fp")))
    named = classes.join(c.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return d.join(named.join(best, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, see ``keep_first``."""
    d = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    return keep_first(docs, d.select(F.col("doc_id").alias("h"), F.col("component_id").alias("component")).distinct())
