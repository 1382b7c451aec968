"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Edges at or below this number are finished by union-find in one task; more are contracted first.
LOCAL_EDGES = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    One of our own is set only where it is unset, and only if driver and executors are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hushlake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder, smaller than a checkpoint, and its path, for ``drop_table``.

    Row groups are small, as each task holds a whole one of every column when it writes or reads.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has the driver find which shuffles no plan refers to any more, as their files stay until it does; Python's own references to plans go first."""
    gc.collect()
    spark._jvm.System.gc()


def tidy() -> None:
    """Hands a Python worker's free memory back, as workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library's
        pass


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., and which was which, so that no name of its own can clash with ours."""
    names = {f"c{i}": c for i, c in enumerate(df.columns)}
    return df.select([F.col(f"`{c}`").alias(k) for k, c in names.items()]), names


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # every node to its root
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finish(batches):
    """One bounded task: all remaining edges."""
    a = [np.zeros(0, np.int64)]
    b = [np.zeros(0, np.int64)]
    for x in batches:
        a.append(x["a"].to_numpy(zero_copy_only=False))
        b.append(x["b"].to_numpy(zero_copy_only=False))
    node, root = union_find(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["id", "to"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of the links (a, b), longs: one row (id, component) per linked node.

    ``component`` names the component; it is one of its nodes, not always the smallest.
    Every round each node moves to its neighbour (or itself) of the least hash, edges are
    renamed and the inner ones fall away, so their number falls by a constant factor. Minima are
    pre-aggregated before the shuffle, so a node of very many links is no burden. At most
    ``local_edges`` edges are left to a union-find in a single task.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while e.count() > local_edges:
        both = e.select(F.col("a").alias("id"), F.col("b").alias("to")).union(e.select(F.col("b"), F.col("a")))
        least = F.min(F.struct(F.xxhash64("to").alias("h"), F.col("to").alias("v")))
        m = both.groupBy("id").agg(least.alias("m"))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("v"))
        m = cut(m.select("id", F.least("m", own)["v"].alias("to")))
        steps.append(m)
        e = (
            e.join(m.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a")
            .join(m.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        e = cut(e)
    steps.append(e.repartition(1).mapInArrow(_finish, "id long, to long"))
    out = steps[0].select("id", F.col("to").alias("component"))
    for m in steps[1:]:
        m = m.select(F.col("id").alias("component"), "to")
        out = out.join(m, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return out


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component in ``named``, (h, component) by the hash of each text.

    It is the row with the smallest doc_id, nulls last, then of the smallest hash of its text; of equal rows one.
    """
    rows, names = renamed(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    key = {"o_": F.coalesce(doc_id.cast("string"), F.lit("")), "n_": doc_id.isNull(), "h_": F.xxhash64(text)}
    rows = rows.withColumns(key)
    ids = rows.select(doc_id.alias("doc_id"), *key)
    first = F.min(F.struct("n_", "doc_id", "h_", "o_")).alias("first")
    first = ids.join(named, ids["h_"] == named["h"]).groupBy("component").agg(first).select("first.o_", "first.n_", "first.h_")
    return rows.join(first, ["o_", "n_", "h_"], "left_semi").dropDuplicates(["o_", "n_", "h_"]).select([F.col(k).alias(c) for k, c in names.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
