"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every N-gram of a test item is a seed, so any N untouched words hold one, however often the item has leaked;
an item of fewer words is one seed as a whole.  Stretches of a document around seed hits become passages, and
each is aligned over words with every item that it shares a seed with, but for items so few of whose words the
passage holds that no alignment can reach the least score.  One pass streams over the texts; only what aligns is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, chunks, fresh, save

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: Benchmark grams that are looked up in one pass over the documents; more items go in several passes.
MOST_GRAMS = 2_000_000


def _item_words(batches):
    for columns, texts in chunks(batches):
        w = Words(texts, fold=True)
        words = [w.hash[a:b].tobytes() for a, b in zip(w.ptr[:-1], w.ptr[1:])]
        at, gram, wide = _grams(w, range(1, N + 1))
        own = np.minimum(w.counts, N)  # an item's grams are of N words, or of all that it has
        fits = wide == own[w.text_of()[at]]
        at, gram = at[fits], gram[fits]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, w.ptr), pa.int32()), pa.array(gram.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary()), pa.array(own, pa.int32()), lists], names=["item_id", "words", "width", "grams"])


def _grams(w: Words, widths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, number of words) of all grams of these widths, by place."""
    found = [(at, g, np.full(len(g), k)) for k in widths for at, g in [w.grams(k)]]
    at, gram, wide = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable") if len(found) > 1 else slice(None)
    return at[order], gram[order], wide[order]


def _windows(at: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last hit of each run of hits, runs longer than 12 * reach words cut to windows.

    Windows overlap by 3 * reach words.  No alignment with a positive score is wider (an item's words, and
    MATCH gaps for each), so each lies in a window whole, with its seeds.
    """
    wide = 12 * reach
    if not (at[last] - at[first] > wide).any():
        return first, last
    lows, highs = [], []
    for a, b in zip(first.tolist(), last.tolist()):
        step = np.arange(at[a], max(at[b] - 3 * reach, at[a]) + 1, wide - 3 * reach)
        low = a + np.searchsorted(at[a : b + 1], step)
        high = a + np.searchsorted(at[a : b + 1], step + wide, side="right") - 1
        lows.append(low)
        highs.append(high)
    return np.concatenate(lows), np.concatenate(highs)


def _seeds(ids: np.ndarray, words: list[bytes], grams: list[np.ndarray]) -> tuple:
    """(seeds in order, where each one's items begin, items by seed, item ids, item words, the words of all items and where each one's begin)."""
    pair = np.stack([np.concatenate(grams).view(np.uint64), np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.uint64)], axis=1)
    pair = np.unique(pair, axis=0)
    known, first = np.unique(pair[:, 0], return_index=True)
    flat = np.frombuffer(b"".join(words), np.uint64)
    return known, np.append(first, len(pair)), pair[:, 1].astype(np.int64), ids, words, flat, np.cumsum([0, *[len(x) // 8 for x in words]])


def _worth(cand: np.ndarray, passage: np.ndarray, flat: np.ndarray, ptr: np.ndarray, least: float) -> np.ndarray:
    """The items that can reach the least score: an alignment matches no word of an item that the passage lacks."""
    size = ptr[cand + 1] - ptr[cand]
    end = np.cumsum(size)
    words = flat[np.repeat(ptr[cand] - (end - size), size) + np.arange(end[-1])]
    own = np.unique(passage)
    held = own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words
    return cand[np.add.reduceat(held, end - size, dtype=np.int64) >= least * size - 1e-9]


def _found(sent, widths: list[int], reach: int, margin: int, least: float):
    def run(batches):
        known, begin, by_seed, item_ids, item_words, flat, ptr = sent.value
        for (ids,), texts in chunks(batches):
            w = Words(texts, fold=True)
            at, g, _ = _grams(w, widths)
            place = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = np.flatnonzero(known[place] == g)
            if not len(hit):
                continue
            at, place = at[hit], place[hit]
            who = w.text_of()[at]
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (np.diff(at) > reach)])
            first = np.flatnonzero(new)
            first, last = _windows(at, first, np.concatenate([first[1:], [len(at)]]) - 1, reach)
            doc = who[first]
            low = np.maximum(at[first] - margin, w.ptr[doc])
            high = np.minimum(at[last] + max(widths) + margin, w.ptr[doc + 1])
            pairs, size = [], 0
            for d, a, b, i, j in zip(doc.tolist(), low.tolist(), high.tolist(), first.tolist(), last.tolist()):
                asked = np.unique(np.concatenate([by_seed[begin[s] : begin[s + 1]] for s in np.unique(place[i : j + 1]).tolist()]))
                for k in _worth(asked, w.hash[a:b], flat, ptr, least).tolist():
                    pairs.append((d, a - w.ptr[d], w.hash[a:b], k))
                    size += b - a
                    if size > 1_000_000:
                        yield from _aligned(pairs, ids, item_ids, item_words)
                        pairs, size = [], 0
            yield from _aligned(pairs, ids, item_ids, item_words)

    return run


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman with linear gaps for pairs of word arrays, all pairs at once.

    Returns (score as a share of the item's full score, first word, word after the last) in the passage.
    """
    b = len(items)
    wide, deep = max(map(len, passages), default=0), max(map(len, items), default=0)
    text = np.zeros((b, wide), np.uint64)
    item = np.ones((b, deep), np.uint64)
    for k, (p, q) in enumerate(zip(passages, items)):
        text[k, : len(p)] = p
        item[k, : len(q)] = q
    lengths, sizes = np.array([len(p) for p in passages]), np.array([len(q) for q in items])
    inside = np.arange(wide) < lengths[:, None]
    ramp = -GAP * np.arange(wide + 1)
    h, begin = np.zeros((b, wide + 1), np.int64), np.tile(np.arange(wide + 1), (b, 1))
    best, first, last = np.zeros(b, np.int64), np.zeros(b, np.int64), np.zeros(b, np.int64)
    rows = np.arange(b)
    for i in range(deep):
        same = (text == item[:, i : i + 1]) & inside
        diag = h[:, :-1] + np.where(same, MATCH, MISMATCH)
        up = h[:, 1:] + GAP
        cell = np.maximum(np.maximum(diag, up), 0)
        start = np.where(cell == 0, np.arange(1, wide + 1), np.where(diag >= up, begin[:, :-1], begin[:, 1:]))
        # gaps along the passage: the best cell to the left less its distance, by a running maximum
        key = ((np.concatenate([np.zeros((b, 1), np.int64), cell], axis=1) + ramp) << 32) + np.arange(wide + 1)
        run = np.maximum.accumulate(key, axis=1)
        source = run & ((1 << 32) - 1)
        h = (run >> 32) - ramp
        padded = np.concatenate([np.zeros((b, 1), np.int64), start], axis=1)
        begin = np.take_along_axis(padded, source, axis=1)
        zero = h <= 0
        h[zero] = 0
        begin = np.where(zero, np.arange(wide + 1), begin)
        live = np.where(i < sizes[:, None], np.concatenate([np.zeros((b, 1), np.int64), np.where(inside, h[:, 1:], 0)], axis=1), 0)
        at = live.argmax(axis=1)
        better = live[rows, at] > best
        best[better], first[better], last[better] = live[rows, at][better], begin[rows, at][better], at[better]
    return best / np.maximum(MATCH * sizes, 1), first, last


def _aligned(pairs: list[tuple], ids: pa.Array, item_ids: np.ndarray, item_words: list[bytes]):
    """Scores of pairs (text, first word of its passage, the passage, item)."""
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][2]))
    low = 0
    while low < len(order):
        # as many pairs of similar length as fit about a million cells; one pair at least
        high = low + 1
        while high < len(order) and (high - low + 1) * (len(pairs[order[high]][2]) + 1) <= 100_000:
            high += 1
        docs, starts, texts, items = zip(*(pairs[k] for k in order[low:high]))
        score, first, last = align(list(texts), [np.frombuffer(item_words[k], np.uint64) for k in items])
        base = np.array(starts, np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(item_ids[list(items)]), pa.array(score), pa.array(base + first), pa.array(base + last)], names=["doc_id", "item_id", "score", "first_word", "end_word"])
        low = high


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of each document and test item that align well.

    score is the best local alignment's share of the item's full score, at least `least`;
    of several passages the best counts, then the first.  Items of fewer than N words are found
    where all their words stand together; items without a word are compared with nothing.  Null texts and null
    item ids give no row; a document with a null id keeps its row; repeated rows of a document count once.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = benchmark.where("item_id is not null and text is not null").withColumn("item_id", F.col("item_id").cast("long"))
    items = save(as_bytes(known, "item_id").mapInArrow(_item_words, "item_id long, words binary, width int, grams array<long>").where(F.size("grams") > 0).dropDuplicates(["item_id", "words"]), "items")
    n, most = items.agg(F.sum(F.size("grams").cast("long")), F.max(F.size("grams"))).first()
    blocks = -(-(n or 0) // MOST_GRAMS)
    found = None
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = some.select("item_id", "words", "width", "grams").toArrow()  # MOST_GRAMS or one item's more
        if rows.num_rows:
            got = _one_block(docs, rows, most + N, least)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    best = found.where(F.col("score") >= least).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.end_word")


def _one_block(docs: DataFrame, items: pa.Table, reach: int, least: float) -> DataFrame:
    grams = [np.array(g, np.int64) for g in items["grams"].to_pylist()]
    sent = docs.sparkSession.sparkContext.broadcast(_seeds(items["item_id"].to_numpy(), items["words"].to_pylist(), grams))
    # an alignment of this score has no more matches than the item words, and no more gaps and mismatches than use up the rest of
    # its full score, so it lies whole beside any seed in it
    margin = math.ceil((3 - 2 * max(least, 0)) * reach)
    return as_bytes(docs, "doc_id").mapInArrow(_found(sent, sorted(set(items["width"].to_pylist())), reach, max(margin, reach), least), "doc_id long, item_id long, score double, first_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents without a leak, with all their columns; rows with a null id stay."""
    name = fresh(docs, "leaked")
    bad = leaks(docs, benchmark, least).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
