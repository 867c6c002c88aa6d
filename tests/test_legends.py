"""Legends over several paragraphs, and what callouts name."""

import pytest
from pyspark.sql import functions as F

from veldspar.operators import legends as g

SCHEMA = "doc_id string, idx int, text string, section string, is_heading boolean"


def paper(spark, *texts, section="results"):
    return spark.createDataFrame([("d", i, t if isinstance(t, str) or t is None else t[0], section if isinstance(t, str) or t is None else t[1], isinstance(t, tuple) and t[1] == "heading") for i, t in enumerate(texts)], SCHEMA)


def test_a_legend_goes_on_until_a_blank_a_heading_or_a_legend(spark):
    told = g.runs(
        paper(
            spark, "Figure 1. Title of it", "(A) One, as in Fig. 7", "goes on with Figure 8.", "", "Fig. 9 stands free", "Figure 2: Other", "plain text with Fig. 6", "Fig. 3 Title (A-C) and", "a) more", ("Heading", "heading"), "(B) after it in Fig. 5",
            "Supplementary Table S1. Title", "B) rows", None, "(C) rows",
        )
    )
    assert sorted(r.idx for r in told.where("absorbed").collect()) == [1, 2, 8, 12]
    got = {r.idx: (r.kind, r.grp, r.number, r.n_absorbed, "".join(r.panels)) for r in g.legends(told).collect()}
    assert got == {0: ("figure", "main", 1, 2, "A"), 5: ("figure", "main", 2, 0, ""), 7: ("figure", "main", 3, 1, "ABC"), 11: ("table", "supplementary", 1, 1, "")}
    assert sorted((r.idx, r.number) for r in g.callouts(told).collect()) == [(4, 9), (6, 6), (10, 5)]


def test_entries_that_look_like_legends_are_none(spark):
    told = g.runs(paper(spark, "Figure 1. Adler et al. in J Water 1999;3", "(B) x", "Figure 2. Adler et al. (A) shows", "Figure 3 extends this", "Figure 4, related to Figure 1. Title", "Figure 5, Title", "Extended Data Figure 6 | Title"))
    assert sorted((r.idx, r.number, r.grp) for r in g.legends(told).collect()) == [(2, 2, "main"), (4, 4, "main"), (5, 5, "main"), (6, 6, "extended")]
    assert told.where("absorbed").count() == 0
    assert g.legends(g.runs(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize(
    "spec, items",
    [
        ("1", {"1": ""}), ("1A-C, 2 and S3b", {"1": "ABC", "2": "", "S3": "B"}), ("1-3", {"1": "", "2": "", "3": ""}), ("S1–S3", {"S1": "", "S2": "", "S3": ""}), ("2 and a", {"2": ""}), ("2a, b and c", {"2": "ABC"}), ("2A, b", {"2": "A"}), ("1C-A", {"1": "ABC"}),
        ("1A, 2B-D, 1C", {"1": "AC", "2": "BCD"}), ("1A-3", {"1": "A", "3": ""}), ("3-1", {"3": "", "1": ""}), ("1a word 2", {"1": "A"}), ("1-99999", {"1": "", "99999": ""}), ("", {}), (None, {}),
    ],
)
def test_specs(spark, spec, items):
    got = spark.createDataFrame([(spec,)], "s string").select(g.spec_items(F.col("s")).alias("x")).first().x
    assert {r.label: "".join(r.panels) for r in got} == items


@pytest.mark.parametrize("text, panels", [("x (A) y (B–D) z", "ABCD"), ("(B) (C)", ""), ("A. One. B. Two. D. Four.", "AB"), ("(a, c) and (b)", "ABC"), ("(i) and (A)", "A"), ("", "")])
def test_panels(spark, text, panels):
    assert "".join(spark.createDataFrame([(text,)], "s string").select(g.panels_of(F.col("s")).alias("x")).first().x) == panels


def test_callouts(spark):
    told = g.runs(paper(spark, "See Supplementary Fig. 2, Figures 1-3 and Table S4B; Extended Data Fig. 5a,b here"))
    got = sorted((r.kind, r.grp, r.number, "".join(r.panels), r.short, r.start) for r in g.callouts(told).collect())
    assert got == [("figure", "extended", 5, "AB", True, 53), ("figure", "main", 1, "", False, 26), ("figure", "main", 2, "", False, 26), ("figure", "main", 3, "", False, 26), ("figure", "supplementary", 2, "", True, 4), ("table", "supplementary", 4, "B", False, 42)]
    assert g.callouts(g.runs(paper(spark, "See Fig. 1", section="references"))).collect() == []


def told(spark, *texts):
    return sorted(((r.code, r.para_index, r.detail) for r in g.issues(g.runs(paper(spark, *texts))).collect()), key=str)


def test_issues(spark):
    got = told(
        spark, "Fig. 2A and Figure 1C, then Figures 5, 3", "Figure 1. Title (A) and (B)", "", "Figure 1. Again", "Figure 2: Title (A, B)", "Figure 4. Title", "Table 2. Rows", "Table 3 is named, with Supplementary Fig. 7 and Extended Data Table 1",
    )
    assert got == [
        ("citation_order", 0, "figure main 2 before 1"), ("citation_order", 0, "figure main 5 before 3"), ("duplicate_legend", 3, "figure main 1"), ("mixed_names", None, "2/5"), ("never_cited", 5, "figure main 4"), ("never_cited", 6, "table main 2"),
        ("no_legend", 0, "figure main 3"), ("no_legend", 0, "figure main 5"), ("no_legend", 7, "table main 3"), ("numbering", 5, "figure main 2 4"), ("numbering", 6, "table main start 2"), ("panels_not_cited", 1, "figure main 1 A,B"), ("panels_not_cited", 4, "figure main 2 B"), ("unknown_panel", 0, "figure main 1C"),
    ]
    assert told(spark, "See Table 1 and Table 1 and Supplementary Table 9") == [("no_legends_at_all", None, "table 1")]
    assert told(spark, "nothing", None) == []
