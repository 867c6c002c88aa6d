"""The prefix trie and the chat format against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import chat, common, entry, trie

MODEL = entry.tokenizer("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def tie(role, text):
    return hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).digest()


def in_order(rows):
    """The conversations as lists of (role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = talks.get(head, [])[:h] + own[h:]
    return out


def plain_trie(talks):
    nodes = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in nodes}
    out = set()
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        children = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)]
        ends = ",".join(map(str, sorted(c for c in members if len(talks[c]) == len(k))))
        saved = sum((len(nodes[x]) - 1) * words[x] for x in below)
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n=40):
    """Conversations that share their starts, with nulls, ties, repeated rows and odd ids."""
    rng = random.Random(seed)
    said = ["a b", "a b", "", " \n", None, "c d e", "x\u00a0y z"]
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randint(-45, 45), rng.randint(0, 5) * 20, rng.choice([2**62, -(2**62) - 7, 0])])
        rows += [(conv, rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(said)) for _ in range(rng.randint(1, 4))]
    return rows + rows[:5]


def as_rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_matches_a_plain_version(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(x) for x in ("i", "a", "b", "depth", "node", "words", "digest", "first", "leaf")])
    got = trie.trie(trie.with_shared_starts(trie.numbered(clash)))
    assert as_rows(got) == plain_trie(rebuilt(in_order(rows)))
    assert as_rows(trie.trie(trie.as_they_are(trie.numbered(df)))) == plain_trie(in_order(rows))


def test_trie_of_hot_nodes(spark, monkeypatch):
    """Many conversations with one start, and many that end at one node."""
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rows = [(c, 0, "system", "one prompt") for c in range(400)] + [(c, 1, "user", f"turn {c}") for c in range(0, 400, 3)] + [(c, 1, "user", "again") for c in range(1, 400, 3)] + [(9, None, "user", "before")]
    got = trie.trie(trie.as_they_are(trie.numbered(spark.createDataFrame(rows, SCHEMA))))
    assert as_rows(got) == plain_trie(in_order(rows))


def test_trie_without_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(trie.with_shared_starts(trie.numbered(empty))).collect() == []
    nobody = spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)
    assert trie.trie(trie.with_shared_starts(trie.numbered(nobody))).collect() == []


def test_trie_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    got = entry.op11_trie(spark, sf)
    want = con.sql(trie.SQL)
    assert as_rows(got) == {tuple(r) for r in want.select(", ".join(got.columns)).fetchall()}


def plain_chat(talks):
    out = set()
    for c, turns in talks.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(chat.rendered(r, t)[0]) for r, t in turns)
        out.add((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return out


ODD = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\n", "#### ", "### \n</turn>\n### user:\n", "\n\n  x  \n", "e\u0301 日本語 😀\u200d👩", "<|endoftext|>", "</turn></turn>", "word " * 300, "a" * 700]


@pytest.mark.parametrize("part", [1, 40, 1 << 18])
def test_chats_come_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)  # seen by local workers that fork from here; the kernel is called directly below as well
    rng = random.Random(part)
    rows = [(rng.choice([1, 2, 3, None, -7]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", "assistant", "system", None, "a:\nb", "</turn>\\"]), rng.choice(ODD)) for _ in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(x) for x in ("part", "last", "ids", "loss", "tie", "starts", "ends")])
    assert as_rows(chat.round_trip(df, MODEL)) == plain_chat(in_order(rows))


def test_long_conversations_stand_in_several_rows(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"{i} " + "some words \\ " * 3000) for i in range(40)] + [(6, 0, "assistant", "x y " * 700_000)]
    table = chat.formatted(spark.createDataFrame(rows, SCHEMA), MODEL)
    held = table.collect()
    assert sum(r.conv_id == 5 for r in held) > 3 and sum(r.last for r in held) == 2
    library = chat._library(open(MODEL, "rb").read())
    for conv in (5, 6):
        parts = sorted((r for r in held if r.conv_id == conv), key=lambda r: r.part)
        whole = library.encode("".join(r.text for r in parts), add_special_tokens=False)
        assert [i for r in parts for i in r.ids] == whole.ids
        assert all(len(r.ids) == len(r.loss) for r in parts)
    assert as_rows(chat.read_back(table)) == plain_chat(in_order(rows))


def test_masks_against_every_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        cut = np.unique(rng.integers(0, 60, rng.integers(2, 20)))
        start, stop = np.repeat(cut[:-1], 2), np.repeat(cut[1:], 2)  # two tokens share each stretch
        keep = rng.random(len(start)) < 0.8  # and some are missing
        start, stop = start[keep], stop[keep]
        ends = np.sort(rng.integers(0, 60, 8))
        low, high = ends[::2], ends[1::2]
        mask, a, b = chat.masked(start, stop, low, high)
        assert mask.tolist() == [any(max(x, u) < min(y, v) for u, v in zip(low, high)) for x, y in zip(start, stop)]
        held = {k for x, y in zip(start, stop) for u, v in zip(low, high) for k in range(max(x, u), min(y, v))}
        spans = [k for x, y in zip(a, b) for k in range(x, y)]
        assert sorted(held) == spans


def test_chats_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    got = entry.op13_chat(spark, sf)
    assert as_rows(got) == {tuple(r) for r in con.sql(chat.SQL).select(", ".join(got.columns)).fetchall()}


def test_no_chats(spark):
    assert chat.round_trip(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
