"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A text's features are its words, its pairs of neighbouring words, and the same of the
words' shapes (letter case, digits and marks, runs shortened), each hashed to one of
2^bits weights and valued by its share of the text's words.  Weights are learnt online by
follow-the-regularised-leader with per-coordinate rates, in one task, from a bounded
sample of labelled rows (``SAMPLE`` documents, the smallest by a hash of their key, so
the same at every run); scoring is a sparse dot product, row by row and without a
shuffle, over every whole text.

Defined results: a null or empty text has only the bias, so it gets the base rate; a
label that is null is not learnt from; repeated labels of a document count once (the
lowest); without labels of both kinds every score is that of the bias; an empty table
gives an empty table; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, worker_state

#: most labelled documents to learn from
SAMPLE = 8192
BITS = 18
#: updates aimed at: a small sample is gone through several times
UPDATES, MOST_EPOCHS = 24_000, 12
ALPHA, BETA, L1, L2 = 2.0, 0.01, 1e-5, 1e-4
_SHAPE = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([a-zß-öø-ÿœ]+)|([0-9]+)|(.)\4*", re.DOTALL)


def word_shape(word: str) -> str:
    """``Word,`` is Xx, and ``WORD!!`` is X!: runs of a class of letters or of one mark become one."""
    return "".join("X" if m[1] else "x" if m[2] else "9" if m[3] else m[4] for m in _SHAPE.finditer(word))


class Features:
    """Hashes texts; remembers the two hashes of each word in a bounded table."""

    def __init__(self, bits: int = BITS, remembered: int = 250_000):
        self.shift = np.uint64(64 - bits)
        self.most = remembered
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.hashes = np.zeros((self.most + 1, 2), np.uint64)

    def _place(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self._clear()
            new = list(dict.fromkeys(words))
            if len(new) > self.most:
                self.hashes = np.zeros((len(new) + 1, 2), np.uint64)
        for w in new:
            self.at[w] = k = len(self.at)
            self.hashes[k] = xxhash.xxh64_intdigest(w.encode()), xxhash.xxh64_intdigest(word_shape(w).encode(), 1)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def indices(self, text: str | None) -> tuple[np.ndarray, int]:
        """Weight indices of all features, with repetition, and the number of words."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64), 0
        h = self.hashes[self._place(words)]
        mix = np.uint64(0x9E3779B97F4A7C15)  # an odd constant: 2^64 over the golden ratio
        pairs = (h[:-1] * mix ^ (h[1:] >> np.uint64(7))) * mix
        pairs[h[1:, 0] == h[:-1, 0], 0] = 0  # a word said twice is one and the same pair, whatever the word
        return (np.concatenate([h.ravel(), pairs.ravel()]) >> self.shift).astype(np.int64), len(words)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS) -> np.ndarray:
    """FTRL-proximal over (indices, values, label); the last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    epochs = max(1, min(MOST_EPOCHS, UPDATES // max(1, len(examples))))
    for _ in range(epochs):
        for at, values, label in examples:
            at = np.append(at, size - 1)
            x = np.append(values, 1.0)
            w = weights(at)
            g = (sigmoid(float(w @ x)) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled texts, the first by a hash of the key."""
    once = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_key")).agg(F.min(label).cast("long").alias("_label"))
    chosen = once.withColumn("_order", F.xxhash64("_key")).orderBy("_order", "_key").limit(most)
    # at most ``most`` short rows: safe to broadcast
    found = docs.select(F.col(f"`{doc}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
    # of rows that repeat a key, the least text: as many rows as keys
    return found.groupBy("_order", "_key", "_label").agg(F.min("_text").alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Learns the weights; features are made where the texts are, and one task learns from them."""
    sample = labelled_sample(docs, labels, doc, text, label, most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Features(bits)
        for b in batches:
            for order, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, words = hashed.indices(t)
                at, counts = np.unique(at, return_counts=True)
                row = [order, at.astype(np.int32).tobytes(), (counts / max(1, words)).astype(np.float32).tobytes(), y]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["_order", "at", "values", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for _, a, v, y in rows]
        yield pa.RecordBatch.from_arrays([pa.array([train(examples, bits).tobytes()], pa.binary())], ["weights"])

    hashed = sample.select("_order", "_text", "_label").mapInArrow(features, "_order long, at binary, values binary, label long")
    found = hashed.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", into: str = "score", bits: int = BITS) -> DataFrame:
    """Adds ``into``: the probability of label 1 for each whole ``text``."""
    rest = [c for c in df.columns if c != into]
    at_column = rest.index(text)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 2^bits + 1 floats, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, w = worker_state(("quality", bits), lambda: Features(bits)), shared.value
        for b in batches:
            out = []
            for t in each(b.column(at_column)):
                at, words = hashed.indices(t)
                out.append(float(sigmoid(float(w[at].sum(dtype=np.float64)) / max(1, words) + float(w[-1]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, into])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(scored, schema)
