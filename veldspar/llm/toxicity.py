"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and one-word skip-grams of a text's lower-cased
words, hashed to 2**BITS places.  Each coordinate has its own rate and an L1 term, so
only places that tell toxic from other texts get a weight, and the model that goes to
the executors is those places alone.  Learning is online and so is done in one task, over a bounded
sample of labelled rows (SAMPLE, by hash of the id, and FEATURES of them in all); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, chunks, mix

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 16_000
#: Features of those rows that are learned from, at most; rows beyond, in the order of learning, are left out.
FEATURES = 1 << 25
BITS = 22


def features(w: Words, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of every feature occurrence, one kind of feature after another."""
    who, down = w.text_of(), np.uint64(64 - bits)
    yield who, (mix(w.hash ^ np.uint64(0x1B873593)) >> down).astype(np.int64)
    for gap, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        if len(w.hash) > gap:
            a, b = w.hash[:-gap], w.hash[gap:]
            inside = who[gap:] == who[:-gap]
            yield who[gap:][inside], (mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(salt))[inside] >> down).astype(np.int64)


@dataclass
class Weights:
    """The intercept and the places with a weight, in ascending order."""

    bias: float
    place: np.ndarray
    weight: np.ndarray
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.place] = self.weight
        return out

    def score(self, texts: list[bytes], dense: np.ndarray) -> np.ndarray:
        pairs = [owner[some] << self.bits | place[some] for owner, place in features(Words(texts, fold=True), self.bits) for some in [np.flatnonzero(dense[place])]]
        pairs = np.unique(np.concatenate(pairs))  # each feature once a text
        total = self.bias + np.bincount(pairs >> self.bits, dense[pairs & ((1 << self.bits) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 5, bits: int = BITS) -> Weights:
    """FTRL-proximal over rows of distinct places; the intercept has no L1."""
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bn = float(np.log(mean / (1 - mean))), 0.0
    for _ in range(epochs):
        for x, label in zip(rows, y):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -500, 500))) - label
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            bn += g * g
            bias -= alpha / (beta + np.sqrt(bn)) * g
    on = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[on]) * l1 - z[on]) / ((beta + np.sqrt(n[on])) / alpha + l2)
    return Weights(bias, on, w.astype(np.float32), bits)


def _rows(batches):
    for columns, texts in chunks(batches):
        pairs = np.unique(np.concatenate([np.unique(owner << BITS | place) for owner, place in features(Words(texts, fold=True))]))
        cut = np.searchsorted(pairs, np.arange(len(texts) + 1) << BITS)
        x = (pairs & ((1 << BITS) - 1)).astype("<u4")
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "y", "x"])


def _learn(batches):
    rows, y, size = [], [], 0
    for batch in batches:
        for label, x in zip(batch.column("y").to_pylist(), batch.column("x").to_pylist()):
            size += len(x) // 4
            if size <= FEATURES or not rows:
                rows.append(np.frombuffer(x, "<u4").astype(np.int32))
                y.append(label)
    m = ftrl(rows, np.array(y, float)) if rows else Weights(0.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.place.tolist()], pa.list_(pa.int64())), pa.array([m.weight.tolist()], pa.list_(pa.float32()))], names=["bias", "place", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, sample: int = SAMPLE) -> Weights:
    """Fit on at most `sample` labelled rows that `usable` admits, in the order of a hash of the id.

    Null labels and ids are left out.  Rows that share an id and a label count once, with the text whose features sort first.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most `sample` rows of 12 bytes
    each = as_bytes(some, "doc_id", "y").mapInArrow(_rows, "doc_id long, y int, x binary").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    ordered = each.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "y")  # FTRL is sequential
    got = ordered.select("y", "x").mapInArrow(_learn, "bias double, place array<long>, weight array<float>").collect()
    if not got:
        return Weights(0.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    return Weights(got[0].bias, np.array(got[0].place, np.int64), np.array(got[0].weight, np.float32))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score) of every whole text, a row for each row.

    Null and empty texts have no feature and get the intercept's score.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        m = model.value
        dense = m.dense()
        for columns, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(m.score(texts, dense))], names=["doc_id", "score"])

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, score double")
