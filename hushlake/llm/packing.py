"""Packing documents into sequences by best-two-fit."""

from __future__ import annotations

import base64
import gc
import math
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Pieces that are packed together: enough that what the last bins leave empty is no matter, few enough for one task.
SHARD = 20_000
#: Words whose ids a worker remembers; then it starts anew.
REMEMBERED = 120_000

_tokenizers: dict = {}


class WordIds(dict):
    """Ids (little-endian, unsigned, 32 bits) by word, each as it stands after a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()  # unsigned 32 bits, little-endian on every host Spark runs on
        return ids


class ByteBpe:
    """Token ids of a byte-level BPE as a tokenizer file defines them.

    The vocabulary cuts a text before every space between two words, so a word's ids don't depend
    on what stands around and are worked out once. Texts where white space follows a space, or that
    hold a special token's own string, are tokenized as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode, self.words = encode, WordIds(encode)

    def ids(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if SPACES.search(text) or text[-1:] == " ":
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


SPACES = re.compile(r" \s")


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, read once a worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
        gc.freeze()  # else every full collection walks the vocabulary
    return _tokenizers[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of every document, cut where they are more than ``capacity``.

    A null text is empty. ``end_id`` ends each document. Pieces are full but for the first.
    """

    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch["text"]):
                ids = own.ids(t.as_py() or "") + end
                n = len(ids) // 4
                first = n - capacity * ((n - 1) // capacity)
                edges = [0, *range(first, n + 1, capacity)]
                at += [i] * (len(edges) - 1)
                out += [(j, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for j, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = [pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])
        own.words.clear()
        tidy()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, 1 to ``capacity``.

    A bin is filled greedily with the largest piece that still fits. Then its smallest piece is
    taken out if two unpacked pieces together fill the widened gap more tightly.
    """
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    ends = np.cumsum(left)  # pieces of a length lie together in ``order``; the next one is taken from the end
    sizes = np.arange(capacity + 1)

    def largest() -> np.ndarray:
        """For each size the largest unpacked length up to it, else 0."""
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rest, number, below = len(lengths), 0, largest()

    def take(n: int) -> None:
        nonlocal below
        left[n] -= 1
        if not left[n]:
            below = largest()

    while rest:
        own, gap = [], capacity
        while n := int(below[gap]):
            own.append(n)
            take(n)
            gap -= n
        if gap and len(own) > 1 and below[capacity]:
            wide = gap + own[-1]
            a = sizes[1 : wide + 1]
            b = below[wide - a]
            fits = (left[a] > 0) & (b > 0) & ((a != b) | (left[a] > 1))
            both = np.where(fits, a + b, 0)
            best = int(both.argmax())
            if both[best] > own[-1]:
                out, pair = own.pop(), (int(a[best]), int(b[best]))
                for n in pair:
                    own.append(n)
                    take(n)
                left[out] += 1
                below = largest()
        at = 0
        for n in own:
            ends[n] -= 1
            i = order[ends[n]]
            bins[i], offsets[i] = number, at
            at += n
        rest -= len(own)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset: its place in a sequence of at most ``capacity`` tokens.

    ``length`` is 1 to ``capacity``. Pieces are dealt round in shards of about ``shard`` rows, whatever
    their ids, and packed in each alone: no group depends on a key, and a shard leaves at most one bin
    half empty. Sequences are numbered from the shard's number up.
    """
    n = max(1, math.ceil(pieces.count() / shard))

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        whole = pa.Table.from_batches(batches)
        number, offset = best_two_fit(whole["length"].to_numpy().astype(np.int64), capacity)
        whole = whole.append_column("sequence_id", pa.array(base + number)).append_column("offset", pa.array(offset))
        yield from whole.to_batches()

    schema = ", ".join(f"`{k}` {t}" for k, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.repartition(n).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document and its place. Texts cross no shuffle, only one short row a piece does."""
    return pack(cut(token_pieces(docs, path, capacity, end_id)), capacity)
