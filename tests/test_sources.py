"""Readers, writers, parsers and streams on small fixtures."""

import io
import json
import zipfile
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.functions import text
from veldspar.operators import lab, manuscripts, specs
from veldspar.sources import docx, sheets, sinks
from veldspar.streaming import orders as stream


@pytest.mark.parametrize(
    "spec, want",
    [
        ("1", [("1", "")]), ("1A", [("1", "A")]), ("1A-C", [("1", "ABC")]), ("1-3", [("1", ""), ("2", ""), ("3", "")]), ("1A, B and 2C", [("1", "AB"), ("2", "C")]), ("S1-S3", [("S1", ""), ("S2", ""), ("S3", "")]),
        ("2 a thing", [("2", "")]), ("2a,b", [("2", "AB")]), ("1 and 2", [("1", ""), ("2", "")]), ("", []), ("4; more", [("4", "")]),
    ],
)
def test_specs(spec, want):
    assert [(x["label"], "".join(x["panels"])) for x in specs.parse(spec)] == want


@given(st.integers(1, 50), st.integers(1, 8))
@settings(max_examples=40, deadline=None)
def test_ranges_fill_between(a, n):
    assert [x["label"] for x in specs.parse(f"{a}-{a + n}")] == [str(i) for i in range(a, a + n + 1)]


def test_match_offsets_are_those_of_the_text(spark):
    import re

    rx = "[0-9]+ ?mg"
    some = ["no", "5 mg and 17mg", "é 3mg", "1mg2 mg3mg x", ""]
    df = spark.createDataFrame([(s,) for s in some], "text string").select("text", text.matches(F.col("text"), rx).alias("m"))
    assert all([(x.start, x.text) for x in r.m] == [(m.start(), m[0]) for m in re.finditer(rx, r.text)] for r in df.collect())


def test_sections_carry_forward(spark):
    rows = [("d", i, t, s) for i, (t, s) in enumerate([("A title of some words", "Normal"), ("Abstract", "Normal"), ("Text", "Normal"), ("2. Methods:", "Normal"), ("More", "Normal"), ("Special matters", "Heading 1"), ("Last", "Normal")])]
    got = text.with_sections(spark.createDataFrame(rows, "doc_id string, idx int, text string, style string")).orderBy("idx").collect()
    assert [r.section for r in got] == ["front_matter", "abstract", "abstract", "methods", "methods", "special matters", "special matters"]
    assert [r.is_heading for r in got] == [False, True, False, True, False, True, False]


def test_sentences_and_keys(spark):
    r = spark.createDataFrame([("See Fig. 2 here. Smith et al. found 3 mice. It ended!",)], "t string").select(text.sentences(F.col("t")).alias("s"), text.sentence_key(F.lit("Found 3,5 Mice.")).alias("k")).first()
    assert r.s == ["See Fig. 2 here.", "Smith et al. found 3 mice.", "It ended!"] and r.k == "found 0 mice"


def test_versions(spark):
    shape = "doc_id string, idx int, text string, is_heading boolean"
    old = spark.createDataFrame([("d", 0, "The cells were grown for two days. Then they were counted.", False)], shape)
    new = spark.createDataFrame([("d", 0, "Then they were counted. The cells were grown for three days. A wholly different matter now.", False)], shape)
    assert {r.sentence: r.kind for r in manuscripts.changes(old, new).collect()} == {"The cells were grown for three days.": "edited", "A wholly different matter now.": "added"}


def test_clean_manuscript_is_silent_and_planted_faults_show(spark):
    def run(lines):
        df = spark.createDataFrame([("d", i, t, s, False) for i, (s, t) in enumerate(lines)], "doc_id string, idx int, text string, section string, is_heading boolean")
        return {r.code for r in manuscripts.run(df, ["figures", "references", "abbreviations", "consistency"]).where("severity <> 'info'").collect()}

    clean = [("results", "It is in Fig. 1 and (Fig. 2A) as known [1, 2]."), ("figure_legends", "Figure 1. First (A) left."), ("figure_legends", "Figure 2. Second (A) right."), ("references", "1. Smith A. A title. Journal 2001."), ("references", "2. Jones B. Another title. Journal 2002.")]
    assert run(clean) == set()
    assert run([*clean, ("results", "Also Fig. 4 and [7].")]) == {"no_legend", "no_reference"}
    assert run([("results", "It is in Fig. 2A and Fig. 1, [2] then [1]."), *clean[1:]]) == {"citation_order"}
    assert "unknown_panel" in run([("results", "In Fig. 1C then Fig. 2, [1, 2]."), *clean[1:]])


def _docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_are_read(spark, tmp_path):
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>CODE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>' + run("[1]") + '<w:r><w:fldChar w:fldCharType="end"/></w:r>'
    body = f"<w:p>{run('Abstract')}</w:p><w:p>{run('Kept ')}<w:ins>{run('new')}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del>{run(' Homo', '<w:i/>')}{run('2', '<w:vertAlign w:val=\"superscript\"/>')} {field}</w:p><w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(_docx(body))
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {(r.doc_id, r.idx): r for r in docx.read(spark, str(tmp_path)).collect()}
    r = got["a.docx", 1]
    assert r.text == "Kept new Homo2[1]" and r.section == "abstract" and [(s.start, s.end) for s in r.italic_spans] == [(8, 13)] and [(s.start, s.end) for s in r.superscript_spans] == [(13, 14)]
    assert got["a.docx", 2].in_table and got["b.docx", -1].error == "BadZipFile"


def test_order_sheet_round_trip_and_repeats(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Lab list,,\n,,\nItem,Quantity,Total,Date ordered,Status,System\nGloves,4,10.00,2026-01-05,,G1\n,,,,,\nTips,1,,31/02/2026,odd,G2\nGloves,4,10.00,2026-01-05,,G1\n")
    found = sheets.orders(sheets.grid(spark, str(tmp_path / "in.csv")))
    rows = {r.row: r for r in found.collect()}
    assert (rows[3].item, rows[3].account, float(rows[3].unit_price), rows[3].status, rows[3].ordered) == ("Gloves", "G1", 2.5, "ordered", date(2026, 1, 5))
    assert len(rows[5].problems) == 2 and rows[5].status == "requested"
    fresh = sheets.new_orders(found, found.where("false"))
    assert fresh.count() == 2
    sinks.order_sheet(fresh).coalesce(1).write.csv(str(tmp_path / "out"), header=True)
    again = sheets.orders(sheets.grid(spark, str(tmp_path / "out" / "*.csv")))
    assert again.count() == 2 and sheets.new_orders(again, fresh).count() == 0


def test_xlsx_and_samples(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Sample ID</t></si><si><t>RNA seq status</t></si><si><t>done</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>17</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    got = sheets.samples(sheets.grid(spark, str(tmp_path)), ["RNA seq"]).collect()
    assert [(r.sample, r.kind, r.status) for r in got] == [("17", "RNA seq", "done")]


def test_reports_and_calendars(spark):
    issues = spark.createDataFrame([("d", "figures", "info", "x", None, "a"), ("d", "figures", "error", "y", 3, "b")], "doc_id string, check string, severity string, code string, para_index int, detail string")
    assert sinks.text_report(issues).first().report.splitlines() == ["ERROR | paragraph 3 | y | b", "INFO | x | a", "1 error, 0 warning, 1 info"]
    assert [i["code"] for i in json.loads(sinks.json_report(issues).first().report)["issues"]] == ["y", "x"]
    name = "é😀" * 30 + "a\\b;c,d\ne"
    events = spark.createDataFrame([("p", name, date(2026, 1, 2), "final"), ("p", "b", date(2026, 1, 1), "final"), ("p", "b", date(2026, 1, 1), "final"), (None, "b", None, "x")], "person string, id string, day date, kind string")
    (row,) = sinks.calendar(events, date(2026, 10, 1)).collect()
    lines = row.calendar.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and row.calendar.endswith("END:VCALENDAR\r\n")
    whole = row.calendar.replace("\r\n ", "").split("\r\n")
    assert whole[:4] == ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//veldspar//deadlines//EN", "CALSCALE:GREGORIAN"] and whole.count("BEGIN:VEVENT") == 2
    assert whole[5:8] == ["UID:b-final-20260101@veldspar", "DTSTAMP:20261001T000000Z", "DTSTART;VALUE=DATE:20260101"] and "DTEND;VALUE=DATE:20260103" in whole
    said = "é😀" * 30 + "a\\\\b\\;c\\,d\\ne: final"
    assert f"SUMMARY:{said}" in whole and f"DESCRIPTION:{said}" in whole
    files = spark.createDataFrame([("d", None), ("e", None), ("f", "BadZipFile")], "doc_id string, error string")
    assert {r.doc_id: r.status for r in sinks.exit_status(issues, files).collect()} == {"d": 1, "e": 0, "f": 2}


def test_steps_of_orders(spark):
    o = spark.createDataFrame([("1", "requested", None, None, None, None, None)], "id string, status string, approved date, approved_by string, ordered date, received date, received_by string")
    r = lab.advance(o, "received", "me", date(2026, 1, 1)).first()
    assert (r.status, r.ordered, r.received_by) == ("received", date(2026, 1, 1), "me")
    with pytest.raises(ValueError):
        lab.advance(o, "lost", "me", date(2026, 1, 1))


def test_streams(spark, tmp_path):
    rows = [("a", "requested", datetime(2026, 1, 1, 1), 1.0), ("a", "ordered", datetime(2026, 1, 1, 2), 2.5), ("b", "ordered", datetime(2026, 1, 3, 1), 4.0)]
    spark.createDataFrame(rows, "id string, status string, at timestamp, amount double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id string, status string, at timestamp, amount double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("spent", stream.spending(source()), "complete"), ("states", stream.states(source()), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.status, float(r.spent)) for r in spark.table("spent").collect()} == {("requested", 1.0), ("ordered", 2.5), ("ordered", 4.0)}
    assert {r.id: r.status for r in spark.table("states").collect()} == {"a": "ordered", "b": "ordered"}


def test_dates_of_sheets_are_month_first(spark):
    forms = {"2026-03-04": (2026, 3, 4), "03/04/2026": (2026, 3, 4), " 3/4/2026 ": (2026, 3, 4), "3/4/26": (2026, 3, 4), "1/2/70": (1970, 1, 2), "4.3.2026": (2026, 3, 4), "4 Mar 2026": (2026, 3, 4), "04-Mar-2026": (2026, 3, 4), "13/04/2026": None, "2026-02-30": None, "soon": None, "": None}
    rows = spark.createDataFrame([(k,) for k in forms], "s string").select("s", sheets.day(F.col("s")).alias("d")).collect()
    assert {r.s: r.d and (r.d.year, r.d.month, r.d.day) for r in rows} == forms
