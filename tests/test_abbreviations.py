"""Definitions, expansions and uses of abbreviations."""

import pytest
from pyspark.sql import functions as F

from veldspar.operators import abbreviations as a

from .test_citations import issues, paper


@pytest.mark.parametrize(
    "term, short, found",
    [
        ("based on complex microbial extract", "CME", "complex microbial extract"), ("mixed-effects model", "MEM", "mixed effects model"), ("linear mixed-effects", "LM", "linear mixed-effects"), ("area under the curve", "AUC", "area under the curve"),
        ("rate of the change in flow", "RCF", "rate of the change in flow"), ("water", "PCR", None), ("", "PCR", None), ("one of the in by to things", "OT", None), ("alpha beta", "12", None),
    ],
)
def test_expansions(spark, term, short, found):
    row = spark.createDataFrame([(term, short)], "t string, s string").select(a.expansion(F.col("t"), a.letters_of(F.col("s"))).alias("x")).first()
    assert row.x == found


@pytest.mark.parametrize("text, short, there", [("6-methylpteridine-2,4-diamine", "MPDA", True), ("water", "WTR", True), ("water", "WRT", False), ("x" * 60 + "water", "WTR", True), ("water" + "x" * 60, "WTR", False), ("aa", "AAA", False), ("", "A", False)])
def test_letters_in_order(spark, text, short, there):
    assert spark.createDataFrame([(text, short)], "t string, s string").select(a.in_order(F.col("t"), a.letters_of(F.col("s"))).alias("x")).first().x is there


def told(spark, *texts, section="results"):
    p = paper(spark, *[(section, t) for t in texts])
    return a.read(p)


def test_definitions_in_both_forms(spark):
    got = a.definitions(told(spark, "the complex microbial extracts (CMEs) and germ-free (GF, n = 6) mice (Analysis of similarities; ANOSIM) or 6-methylpteridine-2,4-diamine (6-MPDA)", "from a store (QIAGEN, Germany) in (Fig. 2) the (THE) x [DNA sequence length, DSL]"))
    assert sorted((r.idx, r.abbr, r.expansion) for r in got.collect()) == [(0, "ANOSIM", None), (0, "CME", "complex microbial extracts"), (0, "GF", "germ free"), (0, "MPDA", None), (1, "DSL", "DNA sequence length")]


def test_uses_aside_from_definitions_and_quotes(spark):
    got = a.uses(told(spark, "CME first, then complex microbial extract (CME) and CMEs, 'ABC' and 6-MPDA of pMABG in TABLE S1, aB", "“XYZ” “QRS and (5-CME)"))
    assert sorted((r.idx, r.abbr, r.start) for r in got.collect()) == [(0, "CME", 0), (0, "CME", 52), (0, "MPDA", 68), (0, "pMABG", 78), (1, "CME", 16), (1, "QRS", 7)]
    assert a.uses(told(spark, "CME", section="acknowledgments")).collect() == []


def test_issues(spark):
    p = paper(
        spark, ("abstract", "We use CME here"), ("results", "complex microbial extract (CME) and complex microbial extract (CME)"), ("results", "complex mineral extract (CME) by polymerase chain reaction (PCR)"), ("results", "Institute of Water Studies (IWS) and so on"), ("results", "a lonely little term (LLT)"),
        ("methods", "only machine settings (OMS)"), ("results", "QQQ and QQQ or QQQ; VND, VND (VND, France) DNA DNA DNA RB RB RB"), ("results", "IWS x"),
    )
    assert issues(a.issues(a.terms(p, a.read(p)))) == [
        ("defined_twice", 1, "CME main 3"), ("differing_expansions", 2, "CME: complex microbial extract; complex mineral extract"), ("never_defined", 6, "QQQ 3"), ("never_used", 4, "LLT"), ("used_before_defined", 0, "CME"),
    ]
    none = paper(spark, ("results", None), ("results", ""))
    assert a.issues(a.terms(none, a.read(none))).collect() == []
    assert "DNA 3" in issues(a.issues(a.terms(p, a.read(p), standard=["PCR"])))[2][2]


def test_paragraphs_are_read_once(spark):
    p = paper(spark, ("results", "QQQ and QQQ or QQQ (QQQ, France)"))
    per = a.terms(p, a.read(p))
    assert [(r.abbr, r.n_used, r.vendor) for r in per.collect()] == [("QQQ", 4, True)]
    assert per._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_a_long_line_keeps_its_places(spark):
    words = ["complex microbial extract (CME)" if k % 50 == 7 else f"'Q{'X' * (k % 5)}Z'" if k % 9 == 0 else f"Q{'X' * (k % 5)}Zs" for k in range(320)]
    text = " \x01".join(words)
    at, uses, made = 0, [], []
    for k, w in enumerate(words):
        if k % 50 == 7:
            made.append(("CME", at + w.index("CME")))
        elif k % 9:
            uses.append((w[:-1], at))
        at += len(w) + 2
    got = told(spark, text)
    assert sorted((r.start, r.abbr) for r in a.uses(got).collect()) == sorted((s, u) for u, s in uses)
    assert sorted((r.start, r.abbr, r.expansion) for r in a.definitions(got).collect()) == [(s, u, "complex microbial extract") for u, s in made]
    assert {r.lead[-2:] for r in a.definitions(got).collect()} == {" ("} and all("\x01" in r.lead and "\x02" not in r.lead for r in a.definitions(got).collect())


def test_hyphens_in_a_bracket_are_read_one_way(spark):
    """Each way to part a chain of hyphens into words was tried before: without end for a hundred of them."""
    chain = "-".join(["ala"] * 120)
    got = told(spark, f"peptides ({chain}; none) of ABC", f"peptides ({chain}; AAA)", "tests (mixed-effects; ME) or (one; OE)")
    assert sorted((r.idx, r.abbr, r.expansion) for r in a.definitions(got).collect()) == [(1, "AAA", "ala ala ala"), (2, "ME", "mixed effects")]


def test_vendors(spark):
    p = paper(spark, ("acknowledgments", "by (ABC, DEF, Germany) and (GHI) or (xJKL, France)"), ("results", "MNO, here (PQRS"))
    assert sorted(r.abbr for r in a.vendors(a.read(p)).collect()) == ["ABC", "DEF"]
