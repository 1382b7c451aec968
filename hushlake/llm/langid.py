"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Labelled documents the field is fitted on, for each language: those of the least hash.
SAMPLE = 150
#: Words in a chain that the field is fitted on. Texts are labelled as one chain each, however long.
CHAIN = 64
#: Words labelled at once (and the rest of the last text), and words whose scores a task remembers.
BATCH, REMEMBERED = 150_000, 100_000
#: Words whose features are made at once.
NEW = 20_000
BUCKETS = 1 << 16
ROUNDS = 30

LETTER = re.compile(r"[^\W\d_]")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FIRST, _END = 1, 2  # marks around a word


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _on(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash and one more character."""
    return (h ^ (h >> np.uint64(31))) * _MIX + c


def _salted(n: int, salt: int) -> np.ndarray:
    return np.full(n, salt, np.uint64) * _STEP


class Letters(dict):
    """Whether characters are letters."""

    def __missing__(self, c: int) -> bool:
        got = self[c] = LETTER.match(chr(c)) is not None
        return got


_letters = Letters()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): hashed affixes, letter n-grams and the word itself as a lexicon entry, in lower case and without what is no letter at its ends.

    Words without a letter have none. All words are worked on at once, character by character.
    """
    none = np.zeros(0, np.int64)
    low = [w.lower() for w in words]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return none, none
    kinds, at = np.unique(c, return_inverse=True)
    letter = np.fromiter(map(_letters.__getitem__, kinds.tolist()), bool, len(kinds))[at]
    owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    place = np.flatnonzero(letter)
    if not len(place):
        return none, none
    word, begin = np.unique(owner[place], return_index=True)  # of the words with a letter
    first, last = place[begin], place[np.concatenate([begin[1:], [len(place)]]) - 1]
    n = last - first + 1
    m = len(word)
    size = n + 2
    start = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(start, size)
    marked = np.empty(len(within), np.uint64)
    inner = (within > 0) & (within <= np.repeat(n, size))
    marked[inner] = c[(np.repeat(first - 1, size) + within)[inner]]
    marked[start], marked[start + n + 1] = _FIRST, _END
    own = np.repeat(np.arange(m), size)
    found, of = [], []

    def add(h: np.ndarray, w: np.ndarray) -> None:
        found.append(_bucket(h))
        of.append(word[w])

    pair = _on(_on(_salted(len(marked) - 1, 1), marked[:-1]), marked[1:])
    whole = own[:-1] == own[1:]
    add(pair[whole], own[:-1][whole])
    triple = _on(pair[:-1] + _STEP, marked[2:])
    whole = own[:-2] == own[2:]
    add(triple[whole], own[:-2][whole])
    every = np.arange(m)
    for salt, most, forward in ((2, 3, True), (3, 4, False)):  # affixes; of shorter words the whole
        h = _salted(m, salt)
        for i in range(most):
            has = n > i
            h = np.where(has, _on(h, marked[np.where(has, start + 1 + i if forward else start + n - i, 0)]), h)
            add(_on(h, np.uint64(i)), every)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max()) + 1, _MIX)]))
    add(_on(np.add.reduceat(_on(marked, power[within]) * power[within], start), n.astype(np.uint64)), every)
    return np.concatenate(found), np.concatenate(of)


def forward_backward(e: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of the labels in chains of the given lengths, whose log scores follow each other in e (place, label); with ``pairs`` also the sum of the expected transitions.

    ``start`` is one row of log scores for all chains or one for each. All chains advance together, the longest first, so a step is one product of arrays;
    no chain is cut.
    """
    a = np.exp(step).astype(np.float32)
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    n, k = x.shape
    fwd, bwd = np.empty_like(x), np.empty_like(x)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), side="left")  # chains of more than i places
    first = np.exp(np.broadcast_to(start, (len(lengths), k))[order]).astype(np.float32)
    f = first[: going[0]] * x[begin[: going[0]]] if longest else None
    for i in range(longest):
        m = going[i]
        at = begin[:m] + i
        if i:
            f = (f[:m] @ a) * x[at]
        f /= f.sum(axis=1, keepdims=True)
        fwd[at] = f
    b = np.empty((0, k), np.float32)
    for i in range(longest - 1, -1, -1):
        m = going[i]
        at = begin[:m] + i
        new = np.full((m, k), 1.0 / k, np.float32)  # chains that end here
        if len(b):
            new[: len(b)] = (b * x[at[: len(b)] + 1]) @ a.T
            new /= new.sum(axis=1, keepdims=True)
        bwd[at] = b = new
    m = fwd * bwd
    m /= m.sum(axis=1, keepdims=True)
    if not pairs:
        return m, None
    later = np.ones(n, bool)
    later[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(later)
    p = fwd[at - 1][:, :, None] * a * (x[at] * bwd[at])[:, None, :]
    return m, (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Field:
    """labels, feature weights (bucket, label), transitions (label, label), start."""

    labels: list[str]
    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 0) -> Field:
    """Fits the field on whole labelled texts by gradient steps on the likelihood.

    Each text is cut into chains of all its words; start scores are learned from the first chain of each. Every third chain goes on in
    another language from some place on, so that transitions are learned from switches too.
    """
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    chains, marks, firsts = [], [], []
    for text, lang in zip(texts, langs):
        w = [ids.setdefault(x, len(ids)) for x in text.split() if LETTER.search(x)]
        for i in range(0, len(w), CHAIN):
            chains.append(w[i : i + CHAIN])
            marks.append([labels.index(lang)] * len(chains[-1]))
            firsts.append(i == 0)
    field = Field(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if not chains:
        return field
    other = rng.permutation(len(chains))
    known, said = list(chains), list(marks)
    for i in range(0, len(chains), 3):
        at = int(rng.integers(1, CHAIN))
        chains[i], marks[i] = known[i][:at] + known[other[i]][at:], said[i][:at] + said[other[i]][at:]
    lengths = np.array([len(c) for c in chains])
    words, y = np.array(sum(chains, []), np.int64), np.array(sum(marks, []), np.int64)
    begin = np.cumsum(lengths) - lengths
    flat, owner = features(list(ids))
    gold = np.eye(k, dtype=np.float32)[y]
    later = np.ones(len(y), bool)
    later[begin] = False
    at = np.flatnonzero(later)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    opening = np.array(firsts)
    squares = [np.full_like(field.weights, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)]
    total = float(len(words))
    for _ in range(rounds):
        own = np.stack([np.bincount(owner, field.weights[flat, j], len(ids)) for j in range(k)], axis=1).astype(np.float32)
        m, p = forward_backward(own[words], lengths, field.step, field.start * opening[:, None], pairs=True)
        off = gold - m
        by_word = np.stack([np.bincount(words, off[:, j], len(ids)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], axis=1) / total - 1e-7 * field.weights
        for i, (w, g) in enumerate(((field.weights, g), (field.step, (seen - p) / total), (field.start, off[begin[opening]].sum(axis=0) / total))):
            squares[i] += g * g
            w += (0.3 * g / np.sqrt(squares[i])).astype(np.float32)
    return field


class Labeller:
    """Labels texts with a field; remembers the scores of words."""

    def __init__(self, field: Field):
        self.field, self.index = field, {}
        self.scores = np.zeros((1024, len(field.labels)), np.float32)  # the first row: no letter

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of ``scores`` of the words, 0 for those without a letter."""
        if len(self.index) > REMEMBERED:
            self.index.clear()
        index = self.index
        coded = pa.array(words, pa.string()).dictionary_encode()
        known = coded.dictionary.to_pylist()  # each word once
        new = [w for w in known if w not in index]
        for i in range(0, len(new), NEW):
            some_new = new[i : i + NEW]
            flat, owner = features(some_new)
            some, at = np.unique(owner, return_inverse=True)
            n = len(index) + 1
            while n + len(some_new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            for j in range(len(self.field.labels)):
                self.scores[n : n + len(some), j] = np.bincount(at, self.field.weights[flat, j], len(some))
            row = np.zeros(len(some_new), np.int64)
            row[some] = n + np.arange(len(some))
            index.update(zip(some_new, row.tolist()))
        return np.fromiter(map(index.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]

    def marginals(self, words: list[str], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(word, label) marginals of the words of texts of the given lengths, and which words have a letter."""
        rows = self.rows(words)
        m, _ = forward_backward(self.scores[rows], np.array(lengths, np.int64), self.field.step, self.field.start)
        return m, rows > 0

    def words(self, text: str) -> list[tuple[str, str | None]]:
        """The words of a text with the language of each, None for those without a letter."""
        w = text.split()
        if not w or not self.field.labels:
            return [(x, None) for x in w]
        m, lettered = self.marginals(w, [len(w)])
        return [(x, self.field.labels[j] if own else None) for x, j, own in zip(w, m.argmax(axis=1), lettered)]

    def __call__(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        words: list[str] = []
        lengths: list[int] = []

        def flush() -> None:
            k = len(self.field.labels)
            if not words or not k:
                out.extend([("und", 0.0)] * len(lengths))
            else:
                m, lettered = self.marginals(words, lengths)
                text = np.repeat(np.arange(len(lengths)), lengths)[lettered]
                sums = np.stack([np.bincount(text, m[lettered, j], len(lengths)) for j in range(k)], axis=1)
                n = np.bincount(text, minlength=len(lengths))
                best = sums.argmax(axis=1)
                for i, j in enumerate(best.tolist()):
                    out.append((self.field.labels[j], min(1.0, float(sums[i, j] / n[i]))) if n[i] else ("und", 0.0))
            words.clear()
            lengths.clear()

        for t in texts:
            w = (t or "").split()
            words += w
            lengths.append(len(w))
            if len(words) >= BATCH:
                flush()
        flush()
        return out


def held_out(doc_id) -> F.Column:
    """A fifth of the documents by the checksum of their id; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most ``sample`` labelled documents a language that aren't held out, whole texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n")
    rows = known.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        got = [r for b in batches for r in zip(b["lang"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist())]
        got = sorted(r for r in ((lang, d, t or "") for lang, d, t in got) if LETTER.search(r[2]))
        field = fit([r[2] for r in got], [r[0] for r in got])
        del got
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in (field.weights, field.step, field.start)]
        yield pa.RecordBatch.from_arrays([pa.array([field.labels], pa.list_(pa.string())), *arrays], ["labels", "weights", "step", "start"])
        tidy()

    # a worker fits, not the driver, whose memory this would take for good: of the sample only the field comes back
    r = rows.select(F.col("lang").cast("string"), "doc_id", F.col("text").cast("string")).repartition(1).mapInArrow(run, "labels array<string>, weights binary, step binary, start binary").first()
    if r is None or not (k := len(r["labels"])):
        return fit([], [])
    w, step, start = (np.frombuffer(bytes(r[c]), np.float32) for c in ("weights", "step", "start"))
    return Field(list(r["labels"]), w.reshape(BUCKETS, k), step.reshape(k, k), start)


def identify(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the mean marginal of that language over the words with a letter.

    A null text and one without a letter are "und" with score 0, as is every text when there was
    nothing to learn from.
    """
    names = docs.columns

    def run(batches):
        label, got, b = Labeller(field), None, None
        for b in batches:
            got = label(x.as_py() for x in b["_text"])
            yield pa.RecordBatch.from_arrays(
                [*(b[f"_{i}"] for i in range(len(names))), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                [*(f"_{i}" for i in range(len(names))), "lang_pred", "score"],
            )
        del label, got, b
        tidy()

    safe = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join([*(f"_{i} {t}" for i, (_, t) in enumerate(docs.dtypes)), "lang_pred string", "score double"])
    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, text, lang_pred, score) of every document; see ``train`` and ``identify``."""
    field = train(docs.select("doc_id", "text", "lang"), sample)
    return identify(docs.select("doc_id", "text"), field).withColumn("held_out", held_out("doc_id"))


def speak(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is known with a score of ``least``; all columns as they were."""
    field = train(docs.select("doc_id", "text", "lang"), sample)
    names = docs.columns
    got = identify(docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), field, f"c{names.index('text')}")
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
