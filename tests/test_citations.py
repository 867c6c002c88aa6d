"""Citations found over line breaks and matched to entries, on small manuscripts written by hand."""

import pytest

from veldspar.operators import citations as c

SCHEMA = "doc_id string, idx int, text string, section string, is_heading boolean, superscript_spans array<struct<start:int,end:int>>, footnote_ids array<int>"


def paper(spark, *rows, doc="d"):
    """Paragraphs from (section, text) or (section, text, spans, notes)."""
    full = [(doc, i, r[1], r[0], r[1] in ("References",), *(r[2:] or (None, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r[x] for x in cols) for r in df.collect())


def issues(df):
    return rows(df, "code", "para_index", "detail")


ADLER = ("references", "Adler J, Byrne K. On small things in water and how they move. J Water 12(3):45. doi:10.1234/abc (1991).")
COSTA = ("references", "Costa L. On large things in water and why they do not. J Water 13(3):45 (1992).")


def test_a_citation_broken_over_two_paragraphs_is_found_at_the_first(spark):
    p = paper(spark, ("results", "First words."), ("results", "It was seen (Adler &"), ("results", "Byrne, 1991) and in [Cos92,"), ("discussion", "Adl91] again, as Duval et al. (1994) say"))
    found = c.worded(p)
    assert rows(found, "kind", "idx", "start", "match") == [
        ("keys", 2, 20, "[Cos92, Adl91]"), ("narrative", 3, 17, "Duval et al. (1994)"), ("round", 1, 12, "(Adler & Byrne, 1991)"), ("round", 3, 30, "(1994)"),
    ]
    assert rows(c.keys(found), "key", "idx") == [("Adl91", 2), ("Cos92", 2)]
    assert rows(c.names(found), "idx", "year", "surnames") == [(1, "1991", ["Adler", "Byrne"]), (3, "1994", ["Duval"])]


def test_headings_lists_and_blanks_are_no_body(spark):
    p = paper(spark, ("results", "Seen [Adl"), ("results", ""), ("results", None), ("references", "References"), ("references", "x [Byr91] y"), ("back_matter", "[Cos91]"), ("of their own", "91] and [Byr92]."))
    assert rows(c.worded(p), "idx", "match") == [(6, "[Byr92]")]  # "[Adl 91]" is no key
    assert c.worded(paper(spark, ("results", "nothing here"))).collect() == []
    assert c.worded(spark.createDataFrame([], SCHEMA)).collect() == []


def test_offsets_hold_for_many_matches_and_letters_beyond_ascii(spark):
    lines = [("results", f"été 😀 [Key{i}] und [{'Abc'}{i}; {'Def'}{i}]" + " ü" * (i % 5)) for i in range(200)]
    found = c.worded(paper(spark, *lines)).collect()
    assert len(found) == 400
    for r in found:
        assert lines[r.idx][1][r.start : r.start + len(r.match)] == r.match


def test_names_need_a_year_and_a_surname(spark):
    p = paper(spark, ("results", "(Table 1991) (in 1992) (Adler 12019) [see Byrne 1993b; the 1994; Costa, Duval 1995] (Adler 1990) (Adler 1990) The (1991)"))
    assert rows(c.names(c.worded(p)), "year", "surnames") == [("1990", ["Adler"]), ("1993", ["Byrne"]), ("1995", ["Costa", "Duval"])]


def test_numbers_of_brackets_and_superscripts(spark):
    p = paper(spark, ("results", "a [3, 1-2; 9–7] (4) (c5) [1-99] x6,7", [(33, 36), (0, 1)], None))
    assert [(r.number, r.bracket) for r in c.numbers(p).orderBy("idx", "seq").collect()] == [(1, "["), (2, "["), (3, "["), (9, "["), (7, "["), (4, "("), (1, "["), (99, "["), (6, "["), (7, "[")]


def test_entries_know_their_authors(spark):
    p = paper(spark, ADLER, ("references", "1. Smith, J. A., van Dyke B, & Jones C. A title that goes on. 2001."), ("references", "Adler J et al. Another title of some length here. J Water 1:1 (1999)."), ("references", "A long account of how small things move in water, Nature, 2003, 4:5."), ("references", "Brown C and Green D. Title that is long enough. 10.1/x 2004."))
    held = {r.place: r for r in c.listed(p).collect()}
    assert [held[k].author_count for k in sorted(held)] == [2, 1, None, None, 2]
    assert [held[k].has_authors for k in sorted(held)] == [True, True, True, False, True]
    assert [held[k].has_source for k in sorted(held)] == [True, False, True, True, False]
    assert [held[k].doi for k in sorted(held)] == ["10.1234/abc", None, None, None, "10.1/x"]
    assert held[1].authors == ["adler", "byrne", "on"] or held[1].authors[:2] == ["adler", "byrne"]


def test_keys_of_entries(spark):
    p = paper(spark, ("references", "Adler J, Byrne K (1991). On small things in water and their ways."), ("references", "Costa L (2020). On large things in water and their ways."), ("references", "No year is in this entry at all, as it seems."))
    assert {(r.place, r.key) for r in c.entry_keys(c.listed(p)).collect()} == {
        (1, k + y) for k in ("adl", "adler", "ab", "ab+", "adlbyr") for y in ("91", "1991")
    } | {(2, k + y) for k in ("cos", "costa", "c", "c+") for y in ("20", "2020")}


def test_missing_and_unused_keys(spark):
    p = paper(spark, ("results", "in [ADL91] and [Zed99; zed99] and [AdlByr1991]"), ("results", "[Zed99] [OBr01]"), ("references", "Adler J, Byrne K (1991). On small things in water and ways."), ("references", "Costa L (2020). On large things in water and their ways."))
    held = c.listed(p)
    assert issues(c.key_issues(held, c.keys(c.worded(p)))) == [("key_missing", 0, "zed99"), ("key_missing", 1, "obr01"), ("key_unused", 3, "2")]


def test_missing_and_unused_names_and_notes(spark):
    p = paper(spark, ("results", "(Byrne 1991; Zed 1991) and Costa (1993)", None, [1, 2, 9]), ADLER, COSTA)
    held = c.listed(p)
    assert issues(c.name_issues(held, c.names(c.worded(p)))) == [("name_missing", 0, "Costa 1993"), ("name_missing", 0, "Zed 1991"), ("name_unused", 2, "2")]
    notes = spark.createDataFrame([("d", 1, "Costa, Water, 1992.", "footnote"), ("d", 2, "Costa 1992", "footnote"), ("d", 2, "Zed writes so in 1950.", "endnote"), ("e", 9, "Adler 1991", "footnote")], "doc_id string, note_id int, text string, kind string")
    assert issues(c.name_issues(held, c.noted(p, notes), "note")) == [("note_missing", 0, "Zed 1950"), ("note_unused", 1, "1")]


@pytest.mark.parametrize(
    "body, style",
    [
        ([("results", "[1] [2] (1)")], "numeric"),
        ([("results", "(Adler 1991) [1]")], "numeric"),  # a tie goes to numbers
        ([("results", "(Adler 1991) (Costa 1992) [1]")], "author_year"),
        ([("results", "[Adl91] [Cos92]")], "key"),
        ([("results", "[Adl91] [Cos92] (Adler 1991) (Costa 1992) [1]")], "unknown"),  # mixed
        ([("results", "[1] [77] [88] [99]")], "unknown"),  # most are beyond the list
        ([("results", "nothing")], "unknown"),
    ],
)
def test_styles(spark, body, style):
    p = paper(spark, *body, ADLER, COSTA)
    found = c.worded(p)
    assert [r.style for r in c.styles(c.listed(p), c.numbers(p), c.cited(found)).collect()] == [style]


def test_numbers_against_the_list(spark):
    entries = [("references", f"{k}. Adler J. Work number {k} on water things. J Water 1:{k} (1991).") for k in (1, 2, 3, 4)]
    p = paper(spark, ("results", "[2] [1, 9] (8) [3]"), *entries)
    got = c.number_issues(c.listed(p), c.numbers(p))
    assert issues(got["no_reference"]) == [("no_reference", 0, "9")]  # 8 in round brackets is beyond the list
    assert issues(got["never_cited"]) == [("never_cited", 4, "4")]
    assert issues(got["citation_order"]) == [("citation_order", 0, "1 after 2")] and issues(got["out_of_order"]) == []
    p = paper(spark, ("results", "[4] [3] [2] [1]"), *entries)
    got = c.number_issues(c.listed(p), c.numbers(p))
    assert issues(got["citation_order"]) == [] and issues(got["out_of_order"]) == [("out_of_order", None, "3/4")]
