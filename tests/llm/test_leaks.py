"""Leaks against brute-force alignment: edited often, short, and in large numbers."""

import re

import numpy as np
import pytest

from veldspar.llm import decontaminate


def plain_score(text, item):
    """Smith-Waterman by its recurrence, as a share of the item's full score."""
    before, best = [0] * (len(text) + 1), 0
    for q in item:
        row = [0]
        for j, p in enumerate(text, 1):
            row.append(max(0, before[j - 1] + (2 if p == q else -1), before[j] - 1, row[j - 1] - 1))
        before, best = row, max(best, *row)
    return best / (2 * len(item))


def edited(words, every, how, r):
    out = []
    for k, w in enumerate(words):
        if k % every == every - 1:
            out += {"swap": [f"x{r.integers(1 << 30)}"], "drop": [], "add": [w, f"x{r.integers(1 << 30)}"]}[how]
        else:
            out.append(w)
    return out


def found(spark, docs, items):
    table = lambda d, name: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], f"{name} long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}


@pytest.mark.parametrize("copies", [0, 30])
def test_edits_every_four_to_six_words(spark, copies):
    r = np.random.default_rng(11)
    items = {i: [f"i{i}w{k}" for k in range(18 + 6 * i)] for i in range(4)}
    docs = {}
    for i, item in items.items():
        for every in (4, 5, 6):
            for how in ("swap", "drop", "add"):
                docs[len(docs)] = [*(f"y{r.integers(1 << 30)}" for _ in range(30)), *edited(item, every, how, r), "the", "end"]
    docs |= {1000 + 50 * i + k: items[i] for i in items for k in range(copies)}  # grams that edits spared are then common
    want = {(d, i): s for d, t in docs.items() for i, item in items.items() if (s := plain_score(t, item)) >= decontaminate.LEAST}
    assert len(want) == len(docs)
    assert found(spark, docs, items) == pytest.approx(want)


@pytest.mark.parametrize("copies", [1, 25, 500])
def test_items_of_any_length_in_any_number_of_documents(spark, copies):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 5, 10, 40)}
    docs = {1000 * n + k: [f"a{k}", f"b{k}", *item, f"c{k}", f"d{k}"] for n, item in items.items() for k in range(copies)}
    assert found(spark, docs, items) == {(d, d // 1000): 1.0 for d in docs}


def test_items_of_two_words_stand_whole(spark):
    docs = {1: "x w0 y w1 z".split(), 2: "x w0 w1".split(), 3: "w1 w0".split(), 4: "only one".split()}
    assert found(spark, docs, {7: ["w0", "w1"], 8: ["only"], 9: []}) == {(2, 7): 1.0, (4, 8): 1.0}


def test_leaks_equal_the_alignment_of_all_pairs(spark, sf):
    """Every document of the table with every item, without seeds."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    ids: dict[str, int] = {}
    numbered = lambda t: np.array([ids.setdefault(x, len(ids)) for x in words(t)], np.uint64)
    texts = {r.doc_id: numbered(r.text) for r in docs.select("doc_id", "text").collect() if r.text}
    items = {r.item_id: numbered(r.text) for r in bench.collect()}
    want = {}
    for d, t in texts.items():
        for low in range(0, max(len(t), 1), 1000):  # stretches that overlap by more than the widest alignment
            score, _, _ = decontaminate.align([t[low : low + 1300]] * len(items), list(items.values()))
            for i, s in zip(items, score):
                if s >= decontaminate.LEAST:
                    want[d, i] = max(s, want.get((d, i), 0))
    assert want and max(map(len, items.values())) < 100
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()} == pytest.approx(want)


def test_one_edited_document_in_many_copies(spark):
    item = [f"w{k}" for k in range(15)]
    copy = [f"x{k}" if k in (3, 4, 8, 12) else w for k, w in enumerate(item)]
    copy = [w for k, w in enumerate(copy) if k not in (9, 10)]  # three untouched words stand together twice
    score = plain_score(copy, item)
    got = found(spark, {k: copy for k in range(50)}, {7: item})
    assert got == ({(k, 7): score for k in range(50)} if score >= decontaminate.LEAST else {})
    once = [w for k, w in enumerate(item) if k not in (1, 4, 7, 10)]  # seeds in the last words only
    assert plain_score(once, item) >= decontaminate.LEAST
    assert len(found(spark, {k: once for k in range(50)}, {7: item})) == 50


def test_alignments_far_wider_than_the_item(spark):
    item = [f"w{k}" for k in range(24)]
    copy = [x for k, w in enumerate(item) for x in ([w] if k >= 20 else [w, f"x{k}"])]  # a word put in after each but the last
    want = plain_score(copy, item)
    assert want > decontaminate.LEAST and found(spark, {1: copy}, {7: item}) == {(1, 7): want}
