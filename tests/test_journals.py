"""Layered journal profiles and the checks that read them."""

import json
from datetime import date

import pytest

from veldspar.operators import citations as c
from veldspar.operators import journals as j

from .test_citations import issues, paper

GOOD = {"name": "Water", "limits": {"figures": 6, "total_words": "5000"}, "verified": "2026-01-31", "reference_style": " Numbered "}


def raw(spark, *rows):
    return spark.createDataFrame([(layer, name, text if isinstance(text, str) or text is None else json.dumps(text)) for layer, name, text in rows], j.RAW)


def test_fields_are_read_and_checked(spark):
    given = {
        "good": GOOD, "list": [1], "broken": '{"name": ', "style": {"reference_style": "vancouver"}, "day": {"verified": "2026-02-30"}, "form": {"verified": "31 Jan 2026"}, "limit": {"limits": {"figures": "many"}},
        "authors": {"max_authors_listed": "ten"}, "bare": {}, "nothing": None, "blank": "", "flags": {"require_doi": True, "template": False, "max_authors_listed": 6, "verified": "", "reference_style": ""}, "null": {"limits": {"figures": None}},
    }
    got = {r.file[:-5]: r for r in j.parsed(raw(spark, *[(0, f"{k}.json", v) for k, v in given.items()])).collect()}
    bad = {k: r.problems for k, r in got.items() if r.problems}
    assert bad == {"list": ["not an object"], "broken": ["not an object"], "nothing": ["not an object"], "blank": ["not an object"], "style": ["reference_style"], "day": ["verified"], "form": ["verified"], "limit": ["limits"], "authors": ["max_authors_listed"], "null": ["limits"]}
    assert (got["good"].name, got["good"].limits, got["good"].verified, got["good"].reference_style) == ("Water", {"figures": 6, "total_words": 5000}, date(2026, 1, 31), "numbered")
    assert (got["bare"].name, got["bare"].limits, got["bare"].required_sections, got["bare"].require_doi) == ("bare", {}, [], False)
    assert (got["flags"].require_doi, got["flags"].template, got["flags"].max_authors_listed, got["flags"].verified) == (True, False, 6, None)


def test_the_first_layer_that_can_be_used_stands(spark):
    given = raw(
        spark, (0, "a.json", {"name": "A of mine"}), (2, "a.json", {"name": "A"}), (0, "b.json", "{"), (1, "b.json", {"name": "B loaded"}), (2, "b.json", {"name": "B"}), (1, "t.json", {"name": "T", "template": True}), (2, "t.json", {"name": "T real"}), (3, "e.json", {"name": "E", "template": True})
    )
    assert sorted((r.file, r.layer, r.name) for r in j.overlay(j.parsed(given)).collect()) == [("a.json", 0, "A of mine"), ("b.json", 1, "B loaded"), ("t.json", 2, "T real")]
    assert sorted((r.file, r.name) for r in j.overlay(j.parsed(given), templates=True).collect()) == [("a.json", "A of mine"), ("b.json", "B loaded"), ("e.json", "E"), ("t.json", "T")]
    assert j.overlay(j.parsed(spark.createDataFrame([], j.RAW))).collect() == []


def test_folders_are_read_in_order(spark, tmp_path):
    for folder, name, text in (("mine", "a.json", '{"name":\n "Mine"}'), ("given", "a.json", '{"name": "Given"}'), ("given", "b.json", "broken"), ("given", "note.txt", "{}")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = j.read_raw(spark, [f"file://{tmp_path}/{x}" for x in ("mine", "absent", "given")])
    assert sorted((r.layer, r.file) for r in got.collect()) == [(0, "a.json"), (2, "a.json"), (2, "b.json")]
    assert [r.name for r in j.overlay(j.parsed(got)).collect()] == ["Mine"]


def rules(spark, **fields):
    profile = j.overlay(j.parsed(raw(spark, (0, "w.json", {"name": "Water"} | fields))))
    return j.assigned(spark.createDataFrame([("d", "w.json"), ("x", "none.json")], "doc_id string, file string"), profile)


@pytest.mark.parametrize(
    "fields, codes",
    [
        ({}, {"checked_against", "unverified"}),
        ({"notes": "Pre-filled by hand"}, {"checked_against", "unverified"}),
        ({"notes": "Mind the figures", "verified": "2026-09-01"}, {"checked_against", "notes"}),
        ({"verified": "2026-03-01"}, {"checked_against", "worth_confirming"}),
        ({"verified": "2025-09-01"}, {"checked_against", "out_of_date"}),
    ],
)
def test_provenance(spark, fields, codes):
    assert {r.code for r in j.provenance(rules(spark, **fields), date(2026, 10, 1)).collect()} == codes


def test_headings_of_an_abstract(spark):
    p = paper(spark, ("abstract", "Background: water. methods none"), ("abstract", "Results. all of it. Aim (C++): x"), ("results", "Conclusion: x"))
    want = ["Background", "Methods", "Results", "Conclusion", "Aim (C++)"]
    got = j.abstract_headings(p, rules(spark, abstract_headings=want)).collect()
    assert [(r.severity, r.para_index, r.detail) for r in got] == [("warning", 0, "Methods, Conclusion")]
    assert j.abstract_headings(paper(spark, ("results", "x")), rules(spark, abstract_headings=want)).collect() == []


def test_required_sections(spark):
    p = paper(spark, ("data_availability", "x"), ("results", "Author and first contributions. A wrote, B too"), ("results", "y" * 80 + " funding"))
    want = ["Data availability", "Author contributions", "Funding", "Ethics statement", "Funding"]
    got = j.required_sections(p, rules(spark, required_sections=want, verified="2026-09-01")).collect()
    assert sorted((r.severity, r.detail) for r in got) == [("error", "Ethics statement"), ("error", "Funding")]


def test_style_authors_and_doi(spark):
    entries = [("references", "Adler J, Byrne K, Costa L. On small things in water. J Water 12(3):45. doi:10.1234/abc (1991).")] + [("references", f"Adler J, Byrne K. Work {k} on small things. J Water 1:{k} (199{k % 10}).") for k in range(15)]
    p = paper(spark, ("results", "(Adler 1991)"), *entries)
    held = c.listed(p)
    styles = c.styles(held, c.numbers(p), c.cited(c.worded(p)))
    told = lambda **fields: issues(j.reference_issues(held, rules(spark, **fields), styles))
    assert told(reference_style="numbered") == [("journal_style", 1, "author_year instead of numbered")]
    assert told(reference_style="author_year") == told() == []
    assert told(max_authors_listed=2) == [("too_many_authors", 1, "2: 1")]
    assert told(max_authors_listed=1) == [("too_many_authors", 1, "1: 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 and 4 more")]
    assert told(require_doi=True) == [("doi_required", 2, "none: 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13 and 3 more")]
    assert issues(j.reference_issues(held, rules(spark, reference_style="numbered", require_doi=True))) == told(require_doi=True)
