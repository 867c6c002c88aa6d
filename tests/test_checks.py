"""Reference lists judged whole, and all checks together."""

from datetime import date

import pytest

from veldspar.operators import checks, citations as c

from .test_citations import issues, paper
from .test_journals import rules


def entry(k, text="Adler J, Byrne K. A study of matter {k} in water. J Water 12(3):{k}. doi:10.1234/{k} (1991)."):
    return ("references", f"{k}. " + text.format(k=k))


def test_entries_are_judged_on_their_own(spark):
    rows = [entry(1), entry(2), entry(2, "Adler J. Another study of things {k}. J Water 1:2. doi:10.1/short (1992)."), entry(5, "The long study of many small things in water {k}. J Water 1:2 (1993)."), entry(6, "Costa L. A study {k} that nobody prints anywhere (1994)."), entry(7, "Duval M. A study without a day. J Water 3:4. doi:10.1234/x."), ("references", "8. " + rows_text())]
    held = c.listed(paper(spark, *rows))
    assert issues(c.entry_issues(held)) == [
        ("bad_doi", 2, "10.1/short"), ("doi_coverage", 3, "5/7: 4, 5"), ("duplicate_entry", 6, "7=1"), ("no_authors", 3, "4"), ("no_source", 4, "5"), ("no_year", 5, "6"), ("numbering", 1, "twice 2"), ("numbering", 3, "2 to 5"),
    ]
    assert c.entry_issues(c.listed(paper(spark, ("results", "x")))).collect() == []


def rows_text():
    return "Adler J, Byrne K. A study of matter 1 in water. J Water 12(3):1. doi:10.1234/1 (1991)."


ADLER = ("references", "Adler J, Byrne K. On small things in water and how they move. J Water 12(3):45. doi:10.1234/abc (1991).")


@pytest.mark.parametrize(
    "body, found",
    [
        ([("results", "[1] [4]"), entry(1)], [("no_reference", 0, "4")]), ([("results", "(Zed 1991) (Adler 1991)"), ADLER], [("name_missing", 0, "Zed 1991")]), ([("results", "[Zed91]"), ADLER], [("key_missing", 0, "zed91"), ("key_unused", 1, "1")]),
        ([("results", "none at all"), ADLER], [("no_citations", None, "1")]), ([("results", "[1] (Adler 1991)")], [("no_list", None, "2")]), ([("results", "[1] [77] [88] [99]"), entry(1)], [("style_unknown", None, "4")]), ([("results", "nothing")], []),
    ],
)
def test_a_list_is_held_against_its_own_style(spark, body, found):
    assert issues(c.issues(paper(spark, *body))) == found


def test_notes_are_a_style(spark):
    p = paper(spark, ("results", "x", None, [1]), ADLER)
    notes = spark.createDataFrame([("d", 1, "Zed 1991", "footnote")], "doc_id string, note_id int, text string, kind string")
    assert issues(c.issues(p, notes)) == [("note_missing", 0, "Zed 1991"), ("note_unused", 1, "1")]


def test_all_checks(spark):
    p = paper(
        spark, ("abstract", "We see patients and patients, colour and color color"), ("results", "E. coli, then Escherichia coli in Fig. 2 and [4] at 5 mg and 5mg"), ("results", "complex microbial extract (CME) and Escherichia coli"), ("figure_legends", "Figure 1. Title"), entry(1),
    )
    got = checks.run(p, rules=rules(spark, required_sections=["Funding"], require_doi=True), today=date(2026, 10, 1))
    codes = {(r.check, r.code) for r in got.collect()}
    assert {("figures", "no_legend"), ("references", "no_reference"), ("abbreviations", "never_used"), ("species", "short_before_full"), ("consistency", "spelling"), ("consistency", "unit_spacing"), ("statements", "human_ethics"), ("submission", "size"), ("submission", "required_section"), ("submission", "unverified")} <= codes
    placed = checks.in_order(got).orderBy("seq").collect()
    assert [r.check_rank for r in placed] == sorted(r.check_rank for r in placed) and [r.seq for r in placed] == list(range(1, len(placed) + 1))
    assert {r.check for r in checks.run(p, only=["species"]).collect()} == {"species"}
    with pytest.raises(ValueError, match="no check is called speling"):
        checks.run(p, only=["speling"])
    with pytest.raises(ValueError, match="rules need a day"):
        checks.run(p, rules=rules(spark))
