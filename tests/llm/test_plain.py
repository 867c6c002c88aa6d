"""Learned scores, statistics and chains against the plain restatements."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldspar.llm import quality, substrings, toxicity
from veldspar.llm.common import Words

from . import plain
from .conftest import TEXTS


@pytest.mark.parametrize("seed", range(3))
def test_ftrl_equals_its_definition(seed):
    r = np.random.default_rng(seed)
    rows = [np.unique(r.integers(0, 60, int(r.integers(0, 15)))) for _ in range(150)]
    y = np.array([float((x < 8).sum() > 1) for x in rows])
    got = toxicity.ftrl(rows, y, bits=8)
    bias, weights = plain.ftrl([x.tolist() for x in rows], y.tolist())
    assert got.bias == pytest.approx(bias) and dict(zip(got.place.tolist(), got.weight.tolist())) == pytest.approx(weights, rel=1e-5)


def test_toxicity_equals_its_definition(spark):
    """Training rows in the order of the hash, features spelled out, every score."""
    r = np.random.default_rng(7)
    words = [f"Wört{i}" for i in range(120)]
    rows = [(i, " ".join([*r.choice(words, 25), *(["vile", "Thing"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(240)] + [(900, "", 0), (901, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    usable = F.col("doc_id") % 4 != 1
    order = [x.doc_id for x in df.where(usable).orderBy(F.xxhash64("doc_id", F.lit(1))).collect()]
    text, label = {x[0]: x[1] for x in rows}, {x[0]: x[2] for x in rows}
    bias, weights = plain.ftrl([plain.features(text[i]) for i in order], [label[i] for i in order])
    want = {i: 1 / (1 + np.exp(-bias - sum(weights.get(f, 0) for f in plain.features(t)))) for i, t in text.items()}
    m = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), usable=usable)
    assert weights and {x.doc_id: x.score for x in toxicity.score(df, m).collect()} == pytest.approx(want, rel=1e-4)


def test_repeated_rows_and_many_features_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, "some words here again", int(i % 7 < 3)) for i in range(700)], "doc_id long, text string, toxic int")
    once = toxicity.train(df.drop("toxic").dropDuplicates(), df.select("doc_id", "toxic").distinct())
    many = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert once.bias == many.bias
    rows = [np.arange(k, k + 5, dtype="<u4") for k in range(9)]
    y = [k % 2 for k in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array([x.tobytes() for x in rows])], names=["y", "x"])
    monkeypatch.setattr(toxicity, "FEATURES", 20)
    (got,) = [b.column("bias")[0].as_py() for b in toxicity._learn([batch])]
    assert got == toxicity.ftrl(rows[:4], np.array(y[:4], float)).bias


@pytest.mark.parametrize("seed", range(3))
def test_trees_equal_their_definition(seed):
    r = np.random.default_rng(seed)
    x = r.random((130, 4)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3] * 5)
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) ^ (r.random(130) < 0.1)).astype(float)
    got = quality.fit(x, y, rounds=12).score(x)
    model = plain.grow(x.tolist(), y.tolist(), rounds=12)
    assert got == pytest.approx([model(row) for row in x.tolist()], abs=1e-6)


def test_statistics_equal_their_definition(texts):
    some = [t or "" for t in texts.values()] + TEXTS + ["a\n\nb\n", "| x | y\n| x | y\n", "!? END. end; É é"]
    for low in range(0, len(some), 40):
        part = some[low : low + 40]
        got = quality.measure([t.encode() for t in part])
        for t, row in zip(part, got):
            assert row.tolist() == pytest.approx(plain.statistics(t), rel=1e-5, abs=1e-6)


def test_statistics_of_slabs(texts, monkeypatch):
    some = [(t or "").encode() for t in texts.values()]
    want = quality.measure(some)
    monkeypatch.setattr(quality, "SLAB", 777)
    assert (quality.measure(some) == want).all()


@pytest.mark.parametrize("slab", [5, 64, 1000])
def test_words_hashed_in_slabs(texts, monkeypatch, slab):
    from veldspar.llm import common

    some = [(t or "").encode() for t in list(texts.values())[:40]]
    want = Words(some, fold=True).hash
    monkeypatch.setattr(common, "SLAB", slab)
    assert (Words(some, fold=True).hash == want).all()


def plain_chains(x, y, span):
    """Matches joined along diagonals, each segment linked to the best earlier one by trying all."""
    k, runs = substrings.K, {}
    for a, b, n in sorted(zip(x, y, span)):
        runs.setdefault(b - a, []).append((a, a + n + k - 1))
    segments = []
    for d, some in runs.items():
        start, last, stop = None, None, None
        for a, b in some:
            if start is None or a - last > k + substrings.WIDTH:
                if start is not None:
                    segments.append((start, stop, start + d, stop + d))
                start, stop = a, b
            last, stop = a, max(stop, b)
        segments.append((start, stop, start + d, stop + d))
    segments.sort()
    value, back = [], []
    for i, (x0, x1, y0, y1) in enumerate(segments):
        cost = substrings.COST
        before = [(value[j] + cost * (s[1] + s[3]), j) for j, s in enumerate(segments[:i]) if s[1] <= x0 and s[3] <= y0]
        best, j = max(before, default=(-np.inf, -1))
        gain = best - cost * (x0 + y0)
        linked = j >= 0 and gain > 0 and max(x0 - segments[j][1], y0 - segments[j][3]) <= substrings.REACH
        value.append(x1 - x0 + (gain if linked else 0.0))
        back.append(j if linked else -1)
    used, out = set(), []
    for i in sorted(range(len(segments)), key=lambda i: (-value[i], i)):
        parts = []
        while i >= 0 and i not in used:
            used.add(i)
            parts.append(segments[i])
            i = back[i]
        if parts:
            out.append(parts[::-1])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_chains_equal_those_by_trying_all_pairs(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    x = np.sort(r.integers(0, 260, n))
    y = np.clip(x + r.choice([0, 0, 3, -7, 40, 90], n) + r.integers(0, 2, n), 0, None)
    span = r.integers(1, 4, n)
    assert substrings.chain(x, y, span) == plain_chains(x.tolist(), y.tolist(), span.tolist())


def test_hot_seeds_dealt_to_copies(docs, monkeypatch):
    from veldspar.llm import common

    want = sorted(map(tuple, substrings.passages(docs).collect()))
    monkeypatch.setattr(common, "HOT", 3)
    assert want and sorted(map(tuple, substrings.passages(docs).collect())) == want


def test_hot_fingerprints_are_sent_out(docs, monkeypatch):
    from veldspar.llm import common, simhash

    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "HOT", 2)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_large_tables_of_passages_give_the_same(docs, monkeypatch):
    want, whole = sorted(map(tuple, substrings.passages(docs).collect())), sorted(map(tuple, substrings.trim(docs).collect()))
    monkeypatch.setattr(substrings, "SMALL_ROWS", 0)
    assert want and sorted(map(tuple, substrings.passages(docs).collect())) == want and sorted(map(tuple, substrings.trim(docs).collect())) == whole


def test_ids_with_several_texts(spark):
    r = np.random.default_rng(1)
    text = lambda n: " ".join(r.choice([f"w{i}" for i in range(900)], n))
    shared, a, b = text(70), text(90), text(90)
    rows = [(1, shared), (2, a + " " + shared), (2, b + " " + shared), (2, b + " " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = df.where("doc_id = 2").orderBy(F.xxhash64("text")).first().text
    want = [(2, chosen.split().index(shared.split()[0], 80), [1])]
    for some in (df, df.repartition(4), df.orderBy(F.desc("text"))):
        assert [(x.doc_id, x.start_word, x.others) for x in substrings.passages(some).collect()] == [(2, 90, [1])], want
        left = sorted(x.text for x in substrings.trim(some).where("doc_id = 2").collect())
        assert left == sorted([chosen[: -len(shared)] if t == chosen else t for t in (x[1] for x in rows[1:])])
