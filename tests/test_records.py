"""Calls and researchers in JSON files, and records that were stored."""

import json
from datetime import date

import pytest

from veldspar.operators import funding
from veldspar.sources import records as r
from veldspar.sources import schemas, sinks

CALL = {"id": "a", "name": "A", "funder": "F", "url": "https://a", "deadlines": [{"date": "2027-03-01", "kind": "internal"}, {"date": "2027-01-15", "estimated": True}]}


def raw(spark, *rows):
    return spark.createDataFrame([(0, f"{name}.json", text if isinstance(text, str) or text is None else json.dumps(text)) for name, text in rows], r.RAW)


def test_a_call_is_read_whole(spark):
    call = CALL | {
        "career_stage": {"min_years_since_phd": 2}, "nationalities": ["aa", " BB"], "host_countries": ["Any"], "excluded_host_countries": [], "mobility": {"max_months_in_host": 12, "window_years": "3"}, "track": "clinical", "category": "phd", "verified": "2026-05-05",
        "fields": ["neuroscience"], "other_rules": ["ask"], "requirements": {"host_letter": True}, "membership": "", "rolling": False,
    }
    got = r.calls(raw(spark, ("a", call), ("bare", CALL))).collect()
    x, bare = got
    assert x.problems == [] and (x.min_years, x.max_years, x.phd_required, x.breaks_extend) == (2.0, None, True, False)
    assert (x.nationalities, x.hosts, x.host_anywhere, x.excluded_hosts, x.residence) == (["AA", "BB"], None, True, None, None)
    assert (x.max_months, x.window_years, x.clinical_only, x.levels, x.host_letter, x.verified, x.membership, x.annual, x.rolling) == (12, 3, True, ["masters_student", "phd_student"], True, date(2026, 5, 5), None, True, False)
    assert [(d.kind, d.date, d.estimated) for d in x.deadlines] == [("final", date(2027, 1, 15), True), ("internal", date(2027, 3, 1), False)]
    assert (bare.phd_required, bare.host_anywhere, bare.levels, bare.fields, bare.category) == (None, False, None, ["any"], "postdoc")
    assert {f.split()[0] for f in schemas.CALL.split(", ") if ":" not in f or f.startswith("deadlines")} <= set(r.calls(raw(spark)).columns)


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"id": None}, "id"), ({"name": None}, "name"), ({"funder": None}, "funder"), ({"custom": True, "name": " "}, "name"), ({"category": "grant"}, "category"), ({"fields": ["astronomy"]}, "fields"), ({"career_levels": ["dean"]}, "career_levels"), ({"purpose": "fun"}, "purpose"), ({"track": "x"}, "track"),
        ({"verified": "soon"}, "verified"), ({"deadlines": [{"date": "2027-02-30"}]}, "deadline date"), ({"deadlines": [{"kind": "late", "date": "2027-02-01"}]}, "deadline kind"), ({"career_stage": {"min_years_since_phd": "two"}}, "career_stage"), ({"mobility": {"window_years": 3}}, "mobility"),
        ({"nationalities": ["ABC"]}, "nationalities"), ({"residence": "AA"}, "residence"), ({"host_countries": ["any", "AA"]}, "host_countries"),
    ],
)
def test_what_is_wrong_with_a_call(spark, change, problem):
    call = {k: v for k, v in (CALL | change).items() if v is not None}
    assert [x.problems for x in r.calls(raw(spark, ("a", call))).collect()] == [[problem]]


def test_a_shipped_list_is_whole_and_others_are_not(spark):
    own = r.calls(raw(spark, ("a", CALL), ("b", '{"id": '), ("c", [1]), ("d", None), ("t", CALL | {"id": "t", "template": True}), ("e", {"id": "e", "name": "E", "custom": True})))
    assert sorted(x.id for x in r.usable(own).collect()) == ["a", "e"]
    assert sorted((x.file, x.problem) for x in r.damaged(own).collect()) == [("b.json", "not an object"), ("c.json", "not an object"), ("d.json", "not an object")]
    with pytest.raises(ValueError, match="b.json: not an object; c.json"):
        r.shipped(own)
    assert [x.id for x in r.shipped(r.calls(raw(spark, ("a", CALL), ("t", CALL | {"template": True})))).collect()] == ["a"]


def test_lists_lie_over_one_another(spark):
    base = r.shipped(r.calls(raw(spark, ("a", CALL), ("b", CALL | {"id": "b"}))))
    fresh = r.usable(r.calls(raw(spark, ("b1", CALL | {"id": "b", "name": "B1"}), ("b2", CALL | {"id": "b", "name": "B2"}), ("c", CALL | {"id": "c"}), ("x", "damaged"))))
    own = r.usable(r.calls(raw(spark, ("own", {"id": "custom-1", "name": "Mine", "custom": True}))))
    got = r.load(base, fresh, own)
    assert sorted((x.id, x.name, x.custom) for x in got.collect()) == [("a", "A", False), ("b", "B2", False), ("c", "A", False), ("custom-1", "Mine", True)]
    assert funding.detail_dates(got, date(2026, 10, 1)).count() == 6
    with pytest.raises(ValueError, match="the id a$"):
        r.load(base, fresh, r.usable(r.calls(raw(spark, ("own", {"id": "a", "name": "Mine", "custom": True})))))


def test_folders_of_calls(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(CALL, indent=1))
    (tmp_path / "b.json").write_text("{")
    assert sorted((x.file, x.problems) for x in r.read_calls(spark, f"file://{tmp_path}").collect()) == [("a.json", []), ("b.json", ["not an object"])]
    assert r.read_calls(spark, f"file://{tmp_path}/none").collect() == []


def test_researchers_never_raise(spark):
    person = {"phd_date": "2020-06-01", "career_break_months": "6", "nationalities": ["aa"], "residence": "bb", "stays": [{"country": "cc", "start": "2021-01-01"}], "fields": ["neuroscience", "poetry"], "clinical": False, "target_hosts": [], "career_level": "dean"}
    got = {x.person: x for x in r.people(raw(spark, ("p", person), ("bare", {}), ("broken", "{"), ("day", {"phd_date": "June"}), ("code", {"nationalities": "AA"}))).collect()}
    p = got["p"]
    assert (p.phd_date, p.break_months, p.nationalities, p.residence, p.fields, p.clinical, p.targets, p.level) == (date(2020, 6, 1), 6.0, ["AA"], "BB", ["neuroscience"], False, None, None)
    assert [(s.country, s.start, s.end) for s in p.stays] == [("CC", date(2021, 1, 1), None)]
    assert got["bare"].problems == [] and got["bare"].clinical is None
    assert {k: v.problems for k, v in got.items() if v.problems} == {"broken": ["not an object"], "day": ["phd_date"], "code": ["nationalities"]}
    assert all(got["day"][c] is None for c in ("phd_date", "break_months", "nationalities", "fields"))


def test_what_is_stored_is_read_back(spark, tmp_path):
    shape = "id string, day date, tags array<string>, n long"
    rows = [("a", date(2026, 1, 2), ["x", "y"], 3), ("b", None, [], None), ("c\n", date(2026, 3, 4), None, -1)]
    path = f"file://{tmp_path}/out"
    sinks.store(spark.createDataFrame(rows, shape), path)
    got, problems = r.stored(spark, path, shape)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and problems.collect() == []
    (tmp_path / "out" / "part-extra.json").write_text('{"id": "d", "n": 4, "more": 1}\n{"id": \n\n[1, 2\n')
    got, problems = r.stored(spark, path, shape)
    assert got.count() == 4 and [(x.file.rsplit("/", 1)[1], x.lines) for x in problems.collect()] == [("part-extra.json", 2)]
    got, problems = r.stored(spark, path + "/none", shape)
    assert got.collect() == [] and got.columns == ["id", "day", "tags", "n"] and problems.collect() == []
