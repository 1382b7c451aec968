"""Tables that are read and appended to: usage, audit, detections, deliveries, traces."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zlib
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import hmac_sha256
from ..functions.patterns import TRACE_FIELD_BYTES

TRACE = "ts string, request_id string, virtual_key string, status int, latency_ms bigint, error string, kind string, model string, arguments string, output string"


def first_writes(batch: DataFrame, stored: DataFrame | None = None, key: str = "request_id", order: str = "ts_unix_ms") -> DataFrame:
    """The rows of ``batch`` to append: the first of each key, and only keys that aren't stored yet."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(order, *[c for c, t in batch.dtypes if c not in (order, key) and not t.startswith("map")])).alias("r")).select("r.*")
    return first if stored is None else first.join(stored.select(key), key, "left_anti")


def record_usage(batch: DataFrame, path: str) -> None:
    """Appends new usage events, partitioned by day, so that time ranges prune files."""
    spark = batch.sparkSession
    day = F.to_date(F.timestamp_millis("ts_unix_ms"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    rows = first_writes(batch, stored)
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def detections(found: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, key_id, entity_kind, count, ts_unix_ms): different values of each kind in a request."""
    return found.groupBy(request, "key_id", F.col("kind").alias("entity_kind"), "ts_unix_ms").agg(F.countDistinct("value").cast("int").alias("count"))


def signed(payload: Column, secret: bytes) -> Column:
    """The signature header of a delivery's body."""
    return F.concat(F.lit("sha256="), hmac_sha256(secret, payload.cast("binary")))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of rotated files with a given schema; kinds share the columns. Nested arguments stay JSON text."""
    return spark.read.schema(TRACE).json(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The traces in the tar.gz archives of a folder, line by line; one task reads one archive, file after file."""

    def lines(batches):
        for batch in batches:
            for blob in batch.column("content"):
                with tarfile.open(fileobj=io.BytesIO(blob.as_py()), mode="r:gz") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(".jsonl"):
                            file = tar.extractfile(member)
                            while part := list(islice(file, 4096)):
                                yield pa.RecordBatch.from_pydict({"value": [x.decode("utf-8", "replace").rstrip("\r\n") for x in part]})

    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("content")
    text = blobs.mapInArrow(lines, "value string").where(F.trim("value") != "")
    return text.select(F.from_json("value", TRACE).alias("t")).select("t.*")


def shorten(value: Column, most: int = TRACE_FIELD_BYTES) -> Column:
    """A trace's field of at most ``most`` bytes and a mark where it is cut, between characters."""
    cut = F.make_valid_utf8(F.substring(value.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(value) > most, F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("…[truncated]"))).otherwise(value)


def write_traces(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Traces as JSON lines by day; old days are whole folders that can be removed."""
    text = [shorten(F.col(c)).alias(c) if t == "string" and c != "day" else F.col(c) for c, t in rows.dtypes]
    rows.select(*text).withColumn("day", F.substring("ts", 1, 10)).write.mode("append").option("maxRecordsPerFile", per_file).partitionBy("day").json(path)


def retain(spark: SparkSession, path: str, since: str) -> list[str]:
    """The days before ``since`` under a path of traces: what a retention run removes."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=")]
    old = [d for d in days if d.getName()[4:] < since]
    for d in old:
        fs.delete(d, True)
    return sorted(d.getName()[4:] for d in old)


def decode_frames(blob: bytes) -> list[tuple[str, str]]:
    """(event type, payload) of the frames of an event stream: lengths, checksum, headers, payload, checksum. A bad checksum ends it with an error."""
    out, at = [], 0
    while at + 12 <= len(blob):
        total, headers, crc = struct.unpack_from(">III", blob, at)
        if zlib.crc32(blob[at : at + 8]) != crc:
            raise ValueError("bad prelude checksum")
        if at + total > len(blob):
            break
        if zlib.crc32(blob[at : at + total - 4]) != struct.unpack_from(">I", blob, at + total - 4)[0]:
            raise ValueError("bad message checksum")
        names, i, stop = {}, at + 12, at + 12 + headers
        while i < stop:
            n = blob[i]
            name, kind = blob[i + 1 : i + 1 + n].decode(), blob[i + 1 + n]
            i += 2 + n
            size = {0: 0, 1: 0, 2: 1, 3: 2, 4: 4, 5: 8, 8: 8, 9: 16}.get(kind)
            if size is None:
                size = struct.unpack_from(">H", blob, i)[0]
                i += 2
            names[name] = blob[i : i + size]
            i += size
        out.append((names.get(":event-type", b"").decode(), blob[stop : at + total - 4].decode()))
        at += total
    return out


def event_frames(rows: DataFrame, column: str = "blob") -> DataFrame:
    """``rows`` with frames: an array of (event, payload) of a binary column."""

    @F.pandas_udf("array<struct<event:string,payload:string>>")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([[{"event": e, "payload": p} for e, p in decode_frames(bytes(b))] if b is not None else [] for b in blobs])

    return rows.withColumn("frames", run(column))


def encode_frame(event: str, payload: dict) -> bytes:
    """A frame of an event stream, for tests and for replays."""
    name, value, body = b":event-type", event.encode(), json.dumps(payload).encode()
    headers = bytes([len(name)]) + name + b"\x07" + struct.pack(">H", len(value)) + value
    start = struct.pack(">II", 16 + len(headers) + len(body), len(headers))
    start += struct.pack(">I", zlib.crc32(start))
    return (whole := start + headers + body) + struct.pack(">I", zlib.crc32(whole))
