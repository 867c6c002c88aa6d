"""Kneser-Ney models against a plain restatement, in one block and in several."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import language

SENTENCES = {"de": "der hund und die katze sind im haus", "en": "the dog and the cat are in the house", "fr": "le chien et le chat sont dans la maison"}


def spelled(text):
    """Three zeros, then lower-cased letters and single blanks."""
    out = [0, 0, 0]
    for c in text:
        x = ord(c.lower()) if c.isalpha() else 32
        if x != 32 or out[-1] != 32:
            out.append(x)
    return out


class Plain:
    """Interpolated Kneser-Ney of order four by its definition, over dictionaries."""

    def __init__(self, texts):
        counts = Counter(tuple(s[i - 3 : i + 1]) for s in map(spelled, texts) for i in range(3, len(s)))
        self.levels = {4: counts}
        for k in (3, 2, 1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, level in self.levels.items():
            one, two = (sum(n == c for n in level.values()) for c in (1, 2))
            self.discount[k] = min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, n in level.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def chance(self, gram, k=4):
        below = self.chance(gram[1:], k - 1) if k > 1 else 1 / (len(self.levels[1]) + 1)
        total = self.total[k].get(gram[:-1], 0)
        if not total:
            return below
        n, d = self.levels[k].get(gram, 0), self.discount[k]
        return max(n - d, 0) / total + d * self.kinds[k][gram[:-1]] / total * below if n else d * self.kinds[k][gram[:-1]] / total * below

    def entropy(self, text):
        s = spelled(text)
        return sum(-math.log(self.chance(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / max(1, len(s) - 3)


@pytest.fixture(scope="module")
def written(spark):
    r = np.random.default_rng(0)
    rows = [(i, lang, " ".join(r.permutation(words.split())[: r.integers(3, 9)]) + ", 12!") for i, (lang, words) in enumerate(list(SENTENCES.items()) * 20)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string"), rows


@pytest.mark.parametrize("block", [10**6, 60])
def test_models_equal_the_definition(written, block, monkeypatch):
    docs, rows = written
    m = language.train(docs, block=block)
    assert m.names == ["de", "en", "fr"] and (len(m.blocks) == 1 or block == 60 and min(p[0] for p in m.parts) > 1 and min(p[1] for p in m.parts) > 1)
    plain = {name: Plain([t for _, lang, t in rows if lang == name]) for name in m.names}
    r = np.random.default_rng(1)
    letters = [*map(ord, "abcdehimnorstuxyz"), 32, 0]
    some = [tuple(int(x) for x in r.choice(letters, 4)) for _ in range(800)] + [g for p in plain.values() for g in list(p.levels[4])[:200]]
    some = [g for g in some if g[-1]]
    want = np.array([sum(x << 16 * (3 - i) for i, x in enumerate(g)) for g in some], np.uint64)
    if block == 60:
        monkeypatch.setattr(language, "HELD", 0)
    for k, name in enumerate(m.names):
        assert m.chance(k, want) == pytest.approx([plain[name].chance(g) for g in some])
    got = {r.doc_id: r for r in language.predict(docs, m).collect()}
    for i, _, t in rows[:20]:
        each = {name: plain[name].entropy(t) for name in m.names}
        assert got[i].lang_pred == min(m.names, key=each.get) and got[i].entropy == pytest.approx(min(each.values()))


def test_a_model_sums_to_one(written):
    m = language.train(written[0])
    g = m.blocks[0].value[1, False, 0][1][0]
    for context in ("the", "xyz", " ca"):
        c = sum(ord(x) << 16 * (3 - k) for k, x in enumerate(context))
        assert m.chance(1, np.uint64(c) | g).sum() + m.chance(1, np.array([c | 0xFFFF], np.uint64))[0] == pytest.approx(1)


def test_blocks_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, language.predict(docs, language.train(docs)).collect()))
    m = language.train(docs, block=3000)
    assert len(m.blocks) > 7
    monkeypatch.setattr(language, "HELD", 0)
    monkeypatch.setattr(language, "GROUP", 100_000)
    monkeypatch.setattr(language, "SLAB", 4000)
    assert sorted(map(tuple, language.predict(docs, m).collect())) == want


def test_another_language_column(written):
    docs, rows = written
    got = language.predict(docs, language.train(docs.withColumnRenamed("lang", "other"), lang="other")).collect()
    assert sum(r.lang_pred == rows[r.doc_id][1] for r in got) == len(rows)


def test_many_languages(spark):
    """Two hundred made-up languages of their own letters."""
    r = np.random.default_rng(3)
    rows = []
    for k in range(200):
        own = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        rows += [(len(rows), f"l{k:03}", " ".join("".join(r.choice(own, 4)) for _ in range(30))) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.predict(docs, language.train(docs, block=20_000)).collect()
    assert sum(r.lang_pred == rows[r.doc_id][1] for r in got) == len(rows)


def test_every_language_gets_a_limit(spark, written):
    docs, rows = written
    many = docs.unionByName(spark.range(20_000).select((F.col("id") + 1000).alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("the dog and the cat "), F.col("id").cast("string")).alias("text")))
    a, b = language.train(many), language.train(many.repartition(5))
    assert np.isfinite(a.limit).all() and a.limit == pytest.approx(b.limit)


def test_the_limit_counts_every_text(spark, written):
    """The quantile over all distinct training texts that the model gives their own language, each once."""
    docs, _ = written
    more = spark.range(6000).select((F.col("id") + 1000).alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("the dog"), F.substring(F.translate(F.md5(F.col("id").cast("string")), "0123456789", "aeioustrnm"), 1, (F.col("id") % 9 + 1).cast("int"))).alias("text"))
    every = docs.unionByName(more).unionByName(more)
    m = language.train(every)
    rows = {(r.lang, r.text): r.entropy for r in every.join(language.predict(every, m), "doc_id").where("lang = lang_pred").collect()}
    for k, name in enumerate(m.names):
        own = np.ceil(np.array([h for (lang, _), h in rows.items() if lang == name]) * language.STEPS) / language.STEPS
        assert m.limit[k] == pytest.approx(1.1 * np.quantile(own, 0.995), rel=1e-9)
