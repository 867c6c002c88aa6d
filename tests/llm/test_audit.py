"""The filter audit against a plain replay."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from veldspar.llm import audit, common, entry


def plain_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out, total = defaultdict(Counter), Counter()
    parts = set()
    for i, text, source in docs:
        t, part = text or "", source or ""
        parts.add(part)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and first[t] < i}
        for p in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(p):
                c = out[part, "".join(p), k + 1]
                c["redundant"] += gone and fails[x]
                c["unique"] += fails[x] and sum(fails.values()) == 1
                if fails[x] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good"] += i in good
                    c["toxic"] += i in toxic
                    total[part, x] += 1
                c["kept"] += not gone
    return {(part, o, k, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], total[part, o[k - 1]]) for (part, o, k), c in out.items()}


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("hot", [1, 100_000])
def test_audit_matches_a_plain_replay(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(hot)
    words = ["alpha", "beta", "Gamma", "DELTA", "x|y", "é", "a\u00a0b"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " \t", "short $", *(" ".join(rng.choices(words, k=rng.choice([5, 49, 50, 80, 200]))) for _ in range(20)), " ".join(f"w{i}" for i in range(60))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["web", "book", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").select("*", *[F.lit(1).alias(x) for x in ("digest", "first", "part", "failed", "good", "toxic", "n", "number")])
    got = audit.replay(audit.flags(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert rows(got) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.replay(audit.flags(docs, labels)).collect() == []


def test_audit_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    got = entry.op12_audit(spark, sf)
    assert rows(got) == {tuple(r) for r in con.sql(audit.SQL).select(", ".join(got.columns)).fetchall()}
