"""Measures of application documents and what is found in them."""

import pytest

from veldspar.operators import attachments as t

PARAGRAPH = "doc_id string, idx int, text string, is_heading boolean, runs array<struct<size:double,chars:int,raised:boolean>>"
FILE = "doc_id string, kind string, pages int, margins map<string,double>, error string"
RULE = "app string, name string, doc_id string, file_format string, max_pages int, max_words int, sections array<string>, min_font_size double, min_margin_cm double"


def paragraphs(spark, *rows):
    return spark.createDataFrame([(d, i, text, head, runs) for i, (d, text, head, runs) in enumerate(rows)], PARAGRAPH)


def test_measures(spark):
    p = paragraphs(spark, ("a", "A heading of words", True, [(14.0, 15, False)]), ("a", "two words", False, [(11.0, 5, False), (8.0, 3, True), (None, 9, False)]), ("a", None, False, None), ("a", "it's one", None, [(11.0, 6, None)]), ("z", "no file", False, None))
    f = spark.createDataFrame([("a", "docx", 3, {"left": 2.5}, None), ("b", "pdf", None, None, "damaged")], FILE)
    got = {r.doc_id: (r.words, r.sizes, r.pages, r.error) for r in t.measured(p, f).collect()}
    assert got == {"a": (4, {11.0: 11, 14.0: 15}, 3, None), "b": (0, {}, None, "damaged")}


def found(spark, rule, p=None, f=None):
    p = p if p is not None else paragraphs(spark, ("a", "Aims and Methods of work", True, [(12.0, 980, False)]), ("a", "Ethical review. All of it", False, [(9.0, 20, False)]))
    f = f if f is not None else spark.createDataFrame([("a", "docx", 4, {"left": 1.9, "top": 2.0}, None)], FILE)
    required = spark.createDataFrame([("x", "Plan", rule.get("doc_id", "a"), *(rule.get(k) for k in ("file_format", "max_pages", "max_words", "sections", "min_font_size", "min_margin_cm")))], RULE)
    return sorted((r.rule, r.outcome, r.detail) for r in t.checked(required, t.measured(p, f), p).collect())


@pytest.mark.parametrize(
    "rule, findings",
    [
        ({}, []), ({"doc_id": None, "max_words": 1}, [("not_attached", "fail", "")]), ({"doc_id": "gone"}, [("not_found", "fail", "")]), ({"file_format": "pdf"}, [("format", "info", "pdf")]), ({"file_format": "docx"}, []), ({"max_pages": 3}, [("pages", "fail", "4/3")]),
        ({"max_pages": 4}, [("pages", "pass", "4/4")]), ({"max_words": 4}, [("words", "fail", "5/4")]), ({"max_words": 5}, [("words", "pass", "5/5")]), ({"min_font_size": 9.25}, [("text_size", "pass", "9.0")]), ({"min_font_size": 11.0}, [("text_size", "warn", "9.0")]),
        ({"min_font_size": 12.5}, [("text_size", "fail", "9.0")]), ({"min_margin_cm": 1.95}, [("margins", "pass", "")]), ({"min_margin_cm": 2.0}, [("margins", "fail", "left")]), ({"min_margin_cm": 2.5}, [("margins", "fail", "left,top")]),
        ({"sections": ["Methods", "Aims of work", "work aims", "Ethical review", "Ethical review"]}, [("section", "fail", "work aims"), ("section", "pass", "Aims of work"), ("section", "pass", "Ethical review"), ("section", "pass", "Methods")]),
    ],
)
def test_findings(spark, rule, findings):
    assert found(spark, rule) == findings


def test_files_that_tell_little(spark):
    p = paragraphs(spark, ("q", "x", False, None))
    f = spark.createDataFrame([("a", "docx", None, None, None), ("b", None, None, None, "not a zip")], FILE)
    assert found(spark, {"max_pages": 2, "min_font_size": 11.0, "min_margin_cm": 2.0, "max_words": 10}, p, f) == [("pages", "warn", "2"), ("words", "pass", "0/10")]
    assert found(spark, {"doc_id": "b", "max_words": 1}, p, f) == [("unreadable", "fail", "not a zip")]


def test_reminders_and_readiness(spark):
    a = spark.createDataFrame([("x", "narrative", "two pages", True, 2), ("y", None, None, None, 0), ("z", "free", None, False, None)], "app string, cv_format string, cv_notes string, host_letter boolean, n_documents int")
    got = t.reminders(a)
    assert sorted((r.app, r.rule, r.detail) for r in got.collect()) == [("x", "cv_narrative", "two pages"), ("x", "host_letter", ""), ("y", "nothing_asked", ""), ("z", "nothing_asked", "")]
    rows = spark.createDataFrame([("x", "A", "words", "fail", ""), ("x", "A", "pages", "warn", ""), ("y", "B", "pages", "pass", "")], "app string, name string, rule string, outcome string, detail string")
    assert sorted(tuple(r) for r in t.readiness(rows).collect()) == [("x", 1, 1, False), ("y", 0, 0, True)]
