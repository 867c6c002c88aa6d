"""Species names found by a document's own evidence."""

from veldspar.operators import species as s

from .test_citations import issues

SCHEMA = "doc_id string, idx int, text string, section string, is_heading boolean, italic_spans array<struct<start:int,end:int>>"


def paper(spark, *rows, section="results"):
    full = []
    for i, r in enumerate(rows):
        text, spans = r if isinstance(r, tuple) else (r, None)
        full.append(("d", i, text, section, False, spans))
    return spark.createDataFrame(full, SCHEMA)


def names(p):
    return sorted((r.genus, r.epithet, r.idx, r.brief) for r in s.mentions(s.read(p)).collect())


def test_names_need_evidence(spark):
    p = paper(spark, "Alpha diversity and Escherichia coli in Taken together", "E. coli, E.coli and B. subtilis or C. elegans", ("Bacillus subtilis was", [(0, 17)]), "Lactobacillus casei and Lactobacillus spp. here", "Table shows Enterobacteriaceae bloom (E. bloom)")
    assert names(p) == [("Bacillus", "subtilis", 1, True), ("Bacillus", "subtilis", 2, False), ("Escherichia", "coli", 0, False), ("Escherichia", "coli", 1, True), ("Escherichia", "coli", 1, True), ("Lactobacillus", "casei", 3, False)]
    assert names(paper(spark, "Escherichia coli and E. coli", section="references")) == []
    assert names(paper(spark, None, "")) == []


def test_an_initial_stands_for_the_first_genus(spark):
    p = paper(spark, "Enterococcus faecalis and Escherichia coli", "E. coli and E. faecalis")
    assert names(p) == [("Enterococcus", "faecalis", 0, False), ("Enterococcus", "faecalis", 1, True)]


def told(p):
    return issues(s.issues(p, s.read(p)))


def test_issues(spark):
    p = paper(
        spark, "E. coli first", ("Escherichia coli and Escherichia coli", [(0, 16)]), "Then escherichia coli again", ("Bacillus subtilis", [(0, 17)]), "B. subtilis. bacillus subtilis opens", "Bacillus subtilis", "Bacillus sp. and Bacillus spp. and Lactobacillus sp.",
    )
    assert told(p) == [
        ("full_again", 5, "Bacillus subtilis 1"), ("lower_case_genus", 2, "Escherichia coli"), ("mixed_italics", 0, "Escherichia coli 1 2"), ("mixed_italics", 4, "Bacillus subtilis 1 2"), ("short_before_full", 0, "Escherichia coli"), ("sp_and_spp", 6, "Bacillus"),
    ]
    assert told(paper(spark, None, "")) == []


def test_names_without_formatting(spark):
    p = paper(spark, "Escherichia coli", "E. coli").drop("italic_spans")
    assert told(p) == [("never_italic", 0, "Escherichia coli")]
