"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees in flat arrays (feature, threshold, leaf), so all rows
step down all trees together in numpy.  The model is fitted on a bounded sample of
labelled rows (SAMPLE, by hash of the id); every text is measured and scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLAB, SPACED, Words, as_bytes, chunks, segment_sums, small_batches

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "line_ends", "symbols", "pipes", "bangs", "stops", "other", "beyond_ascii",
    "distinct_words", "top_word", "equal_neighbours", "repeated_windows", "repeated_lines", "line_words", "long_words", "odd_ends",
]
_KIND = np.full(256, 8, np.int64)
for _k, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b"#*$%&<>@^~=+_\\{}[]", b"|", b"!?"]):
    _KIND[list(_set)] = _k
_KIND[list(b".,;:")] = 9
_KIND[192:] = 10
_KIND[128:192] = 11


def _runs(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the commonest key's count for each owner."""
    packed = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(packed)]]))
    who = (packed[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, who, size)
    return np.bincount(who, minlength=n), top


def measure(texts: list[bytes]) -> np.ndarray:
    """float32 statistics of each text, in the order of FEATURES; 0 for what an empty text lacks."""
    w = Words(texts, SPACED)
    n, size = w.n, np.diff(w.offset)
    kinds = np.zeros(12 * n)
    for low in range(0, len(w.raw), SLAB):
        high = min(low + SLAB, len(w.raw))
        owner = np.repeat(np.arange(n), np.diff(np.clip(w.offset, low, high)))
        kinds += np.bincount(owner * 12 + _KIND[w.raw[low:high]], minlength=12 * n)
    kinds = kinds.reshape(n, 12)
    kinds[:, 4] -= 1  # the line end that the chunk puts after every text
    length, words = size - 1.0, w.counts.astype(float)
    per = lambda x, y: x / np.maximum(y, 1)
    who = w.text_of()
    distinct, top = _runs(w.hash, who, n)
    same = np.zeros(len(w.hash), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (who[1:] == who[:-1])
    at, grams = w.grams(5)
    windows = np.bincount(who[at], minlength=n)
    line_end = np.flatnonzero(w.raw == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_words = np.searchsorted(w.start, line_end) - np.searchsorted(w.start, line_start)
    full = line_words > 0
    line_who = np.searchsorted(w.offset, line_end, side="right") - 1
    line_hash = np.zeros(len(line_end), np.uint64)
    if len(w.hash):
        wide = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * (np.arange(len(w.hash), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))])
        low, high = np.searchsorted(w.start, line_start), np.searchsorted(w.start, line_end)
        plain = np.concatenate([[np.uint64(0)], np.cumsum(w.hash)])
        total = plain[high] - plain[low]
        line_hash = (wide[high] - wide[low] - total * np.uint64(2) * low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ total
    lines = np.bincount(line_who[full], minlength=n)
    own_lines, _ = _runs(line_hash[full], line_who[full], n)
    ends = _KIND[w.raw[w.stop - 1]] if len(w.stop) else np.zeros(0, np.int64)
    out = [np.log1p(length), np.log1p(words), per(segment_sums(w.stop - w.start, w.ptr), words)]
    out += [per(kinds[:, k], length) for k in (0, 1, 2, 3, 4)]
    out += [per(kinds[:, 5], words), per(kinds[:, 6], words), per(kinds[:, 7], words), per(kinds[:, 9], words), per(kinds[:, 8], words), per(kinds[:, 10], length)]
    out += [per(distinct, words), per(top, words), per(segment_sums(same, w.ptr), words), per(windows - _runs(grams, who[at], n)[0], windows), per(lines - own_lines, lines), per(words, lines)]
    out += [per(segment_sums((w.stop - w.start > 20).astype(np.int64), w.ptr), words), per(segment_sums(np.isin(ends, (5, 6, 7)).astype(np.int64), w.ptr), words)]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Trees:
    """`feature` and `threshold` hold a row of inner nodes for each tree, `leaf` the values below them."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1."""
        total = np.full(len(x), self.base)
        t = np.arange(len(self.leaf))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))[:, None]
        if len(t):
            node = np.zeros((len(x), len(t)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaf[t, node - (1 << depth) + 1].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; splits are sought in histograms of quantile bins."""
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    trees = Trees(float(np.log(mean / (1 - mean))), np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    if len(y) < 20 or y.min() == y.max():
        return trees
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    cell = binned + bins * np.arange(f)
    total = np.full(n, trees.base)
    kept = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for d in range(depth):
            wide, low = 1 << d, (1 << d) - 1
            key = ((node - low)[:, None] * (f * bins) + cell).ravel()
            hist = [np.bincount(key, np.repeat(v, f), wide * f * bins).reshape(wide, f, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in range(wide):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[low + k], threshold[low + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - (1 << depth) + 1
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        total += leaf[at]
        kept.append((feature, threshold, leaf))
    trees.feature, trees.threshold, trees.leaf = (np.stack(v) for v in zip(*kept))
    return trees


def _measured(batches):
    for columns, texts in chunks(batches):
        x = measure(texts)
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled rows that `usable` admits; null labels and ids are left out.

    A document that stands in several rows counts as often, with 2 * sample rows in all at most, in the order of a hash.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # at most `sample` rows of 12 bytes
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    got = as_bytes(some, "doc_id", "y").mapInArrow(_measured, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(2 * sample).collect()
    if not got:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return fit(np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), -1), np.array([r.y for r in got], float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of every whole text, a row for each row; null texts count as empty."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for columns, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.value.score(measure(texts)))], names=["doc_id", "score"])

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, trees: Trees, least: float = 0.3) -> DataFrame:
    """The documents whose score is `least` or more, with all their columns, in one pass over the texts."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            some = [model.value.score(measure(t)) for _, t in chunks([pa.RecordBatch.from_arrays([texts], names=["t"])])]
            yield batch.filter(pa.array(np.concatenate(some) >= least if some else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
