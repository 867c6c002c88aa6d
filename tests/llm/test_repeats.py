"""Passages that stand more than once in a later document."""

import numpy as np
import pytest

from veldspar.llm import substrings


@pytest.mark.parametrize("held", [1, 2])
def test_every_copy_in_a_later_document_is_a_passage(spark, held):
    r = np.random.default_rng(6)
    new = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 7)) for _ in range(n))
    shared, own = new(60), [new(30) for _ in range(6)]
    first = f" {own[0]} ".join([own[1], *[shared] * held])
    rows = [(1, first), (2, f"{own[2]} {shared} {own[3]} {shared} {own[4]} {shared}"), (3, f"{own[5]} {shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.others) for r in substrings.passages(docs).collect())
    assert got == [(2, 30, 90, [1]), (2, 120, 180, [1]), (2, 210, 270, [1]), (3, 30, 90, [1])]
    left = {r.doc_id: r.text.split() for r in substrings.trim(docs).collect()}
    assert left[1] == first.split() and left[2] == f"{own[2]} {own[3]} {own[4]}".split() and left[3] == own[5].split()


@pytest.mark.parametrize("turn", ["und", "the cat", "one two three", "a b c d e f g h"])
@pytest.mark.parametrize("times", [61, 150, 1000])
def test_loops_longer_than_the_first_holders(spark, turn, times):
    period = len(turn.split())
    rows = [(1, "First of all " + (turn + " ") * -(-60 // period)), (2, "then some others stand here " + (turn + " ") * times + "and an end")]
    (got,) = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got.doc_id == 2 and got.others == [1] and 5 <= got.start_word < 5 + period and 5 + times * period - period < got.end_word <= 5 + times * period
