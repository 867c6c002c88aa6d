"""Queries over records: every document gives a funding call's file and a document of an application."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import attachments as t
from veldspar.sources import records

from . import references as r

_S = "CAST({} AS STRING)"
_RAW = f"""SELECT CAST(doc % 2 AS INT) AS layer, concat('c', {_S.format('doc')}, '.json') AS file, CASE WHEN doc % 23 = 0 THEN '{{"id": ' WHEN doc % 29 = 0 THEN '"text"' ELSE concat('{{"id": "call-', {_S.format('doc')}, '"', CASE WHEN doc % 31 = 0 THEN '' ELSE concat(', "name": "Call ', {_S.format('doc')}, '"') END,
 CASE WHEN doc % 7 = 0 THEN ', "custom": true' ELSE ', "funder": "F", "url": "https://f"' END, ', "category": "', CASE doc % 9 WHEN 0 THEN 'phd' WHEN 1 THEN 'travel' WHEN 2 THEN CASE WHEN doc % 4 = 0 THEN 'grant' ELSE 'postdoc' END ELSE 'postdoc' END, '", "fields": ["', CASE WHEN doc % 37 = 0 THEN 'astronomy' ELSE 'neuroscience' END, '"]',
 CASE doc % 5 WHEN 0 THEN '' WHEN 1 THEN ', "host_countries": ["any"]' WHEN 2 THEN ', "host_countries": ["aa", "DD "]' WHEN 3 THEN ', "host_countries": ["ABC"]' ELSE ', "host_countries": []' END, CASE WHEN doc % 6 = 1 THEN ', "nationalities": ["aa", "bb"]' WHEN doc % 6 = 2 THEN ', "nationalities": "AA"' ELSE '' END,
 CASE doc % 8 WHEN 0 THEN ', "career_stage": {{"min_years_since_phd": 2, "career_breaks_extend": true}}' WHEN 1 THEN ', "career_stage": {{"phd_required": false, "max_years_since_phd": "8.5"}}' WHEN 2 THEN ', "career_stage": {{"min_years_since_phd": "two"}}' ELSE '' END, ', "verified": "', CASE WHEN doc % 10 = 3 THEN '2026-02-30' ELSE '2026-05-05' END,
 '", "deadlines": [{{"date": "2027-03-01", "kind": "', CASE WHEN doc % 41 = 0 THEN 'late' ELSE 'internal' END, '"}}, {{"date": "2027-01-1', {_S.format('doc % 10')}, '", "estimated": true}}], "template": ', CASE WHEN doc % 13 = 0 THEN 'true' ELSE 'false' END, '}}') END AS content FROM ids"""
#: A document is the paper j (id modulo 4) of application id div 4; paper 3 is never asked for.
_APP = "concat('a', CAST(CAST((doc - doc % 4) / 4 AS BIGINT) AS STRING))"
_FILES = """SELECT doc, CASE WHEN doc % 17 = 5 THEN CAST(NULL AS STRING) WHEN doc % 3 = 0 THEN 'pdf' ELSE 'docx' END AS kind, CASE WHEN doc % 5 = 0 THEN CAST(NULL AS INT) ELSE CAST(doc % 9 AS INT) END AS pages, 1.9 + (doc % 3) / 10.0 AS side, CASE WHEN doc % 17 = 5 THEN 'damaged' END AS error FROM ids WHERE doc % 19 > 0"""
_LINES = """SELECT doc, i, concat(CASE (doc + i) % 6 WHEN 0 THEN 'Aims and methods of it: ' WHEN 1 THEN 'Ethical review. ' ELSE '' END, line) AS text, i % 7 = 3 AND length(line) < 60 AS is_heading, CASE WHEN (doc + i) % 11 = 0 THEN 9.0 WHEN i % 5 = 0 THEN 12.0 ELSE 11.0 END AS pt, length(line) AS chars, (doc + i) % 13 = 0 AS raised FROM lines"""


def _rows(spark, sf_dir, sql):
    plain = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON, not of the statement's parameters
    return spark.sql(f"WITH {r._TABLES} {plain}", docs=r._docs(spark, sf_dir))


def calls(spark, sf_dir):
    return records.calls(_rows(spark, sf_dir, _RAW)).select(
        "layer", "file", "id", "category", F.array_join("hosts", ",").alias("hosts"), "host_anywhere", F.array_join("nationalities", ",").alias("nationalities"), "min_years", "max_years", "phd_required", "breaks_extend", F.array_join("levels", ",").alias("levels"), "verified", "custom",
        F.get("deadlines", 0)["date"].alias("first_date"), "template", F.array_join(F.array_sort("problems"), ", ").alias("problems"),
    )


def _application(spark, sf_dir):
    """Paragraphs, files and requirements."""
    p = _rows(spark, sf_dir, _LINES).selectExpr("CAST(doc AS STRING) AS doc_id", "CAST(i AS INT) AS idx", "text", "is_heading", "array(named_struct('size', CAST(pt AS DOUBLE), 'chars', chars, 'raised', raised)) AS runs")
    f = _rows(spark, sf_dir, _FILES).selectExpr("CAST(doc AS STRING) AS doc_id", "kind", "pages", "map('left', CAST(side AS DOUBLE), 'top', CAST(side + 0.2 AS DOUBLE)) AS margins", "error")
    q = _rows(spark, sf_dir, f"SELECT {_APP} AS app, CAST(doc AS STRING) AS doc, CAST(doc % 4 AS INT) AS j, doc % 7 AS seven FROM ids WHERE doc % 4 < 3").selectExpr(
        "app", "CASE j WHEN 0 THEN 'Proposal' WHEN 1 THEN 'CV' ELSE 'Plan' END AS name", "CASE WHEN seven > 0 THEN doc END AS doc_id", "CASE WHEN j = 0 THEN 'pdf' WHEN j = 1 THEN 'docx' END AS file_format", "CASE WHEN j < 2 THEN 5 END AS max_pages", "CASE WHEN j <> 1 THEN 150 END AS max_words",
        "CASE j WHEN 0 THEN array('Aims of it', 'Ethical review', 'Budget') WHEN 1 THEN array() ELSE array('methods') END AS sections", "CASE WHEN j < 2 THEN 10.0D END AS min_font_size", "CASE WHEN j = 2 THEN NULL ELSE 2.0D END AS min_margin_cm",
    )
    return p, f, q


def measured(spark, sf_dir):
    p, f, _ = _application(spark, sf_dir)
    return t.measured(p, f).select("doc_id", "kind", "pages", "words", F.array_join(F.transform(F.map_entries("sizes"), lambda e: F.concat_ws(":", e["key"].cast("int"), e["value"])), " ").alias("sizes"))


def findings(spark, sf_dir):
    p, f, q = _application(spark, sf_dir)
    return t.checked(q, t.measured(p, f), p)


_IDS = r.P[: r.P.index("p AS (")]
_CODES = "list_transform(CAST(c->'{0}' AS VARCHAR[]), lambda x: upper(trim(x)))"
_ANY = "coalesce(json_type(c->'host_countries') = 'ARRAY' AND " + _CODES.format("host_countries") + " = ['ANY'], false)"
_LIST = "CASE WHEN json_type(c->'{0}') = 'ARRAY' THEN " + _CODES + " END"
_BAD = "CASE WHEN (c->'{0}') IS NOT NULL AND (json_type(c->'{0}') <> 'ARRAY' OR len(list_filter(" + _LIST + ", lambda x: NOT regexp_full_match(x, '[A-Z]{{2}}'))) > 0) THEN '{0}' END"
_CALLS = f"""{_IDS} rw AS ({r._duck(_RAW)}), wh AS (SELECT layer, file, json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content ELSE '0' END) = 'OBJECT' AS whole, CASE WHEN json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content ELSE '0' END) = 'OBJECT' THEN json(content) ELSE json('{{}}') END AS c FROM rw),
ca AS (SELECT layer, file, (c->>'id') AS id, coalesce((c->>'category'), 'postdoc') AS category, CASE WHEN NOT {_ANY} THEN {_LIST.format('host_countries')} END AS hosts, {_ANY} AS host_anywhere, {_LIST.format('nationalities')} AS nationalities, try_cast((c->'career_stage')->>'min_years_since_phd' AS DOUBLE) AS min_years,
  try_cast((c->'career_stage')->>'max_years_since_phd' AS DOUBLE) AS max_years, CASE WHEN (c->'career_stage') IS NOT NULL THEN coalesce((c->'career_stage'->>'phd_required'), 'true') = 'true' END AS phd_required, coalesce((c->'career_stage'->>'career_breaks_extend'), 'false') = 'true' AS breaks_extend,
  try_cast(c->>'verified' AS DATE) AS verified, coalesce((c->>'custom'), 'false') = 'true' AS custom, least(try_cast((c->'deadlines'->0)->>'date' AS DATE), try_cast((c->'deadlines'->1)->>'date' AS DATE)) AS first_date, coalesce((c->>'template'), 'false') = 'true' AS template, whole,
  CASE WHEN NOT whole THEN ['not an object'] ELSE list_sort(list_filter([CASE WHEN (c->>'name') IS NULL THEN 'name' END, CASE WHEN coalesce((c->>'custom'), 'false') <> 'true' AND (c->>'funder') IS NULL THEN 'funder' END, CASE WHEN (c->>'category') NOT IN ('phd', 'travel', 'postdoc') THEN 'category' END,
   CASE WHEN ((c->'fields')->>0) <> 'neuroscience' THEN 'fields' END, CASE WHEN try_cast(c->>'verified' AS DATE) IS NULL THEN 'verified' END, CASE WHEN ((c->'deadlines'->0)->>'kind') NOT IN ('final', 'internal', 'pre_proposal', 'call_opens') THEN 'deadline kind' END,
   CASE WHEN ((c->'career_stage')->>'min_years_since_phd') IS NOT NULL AND try_cast((c->'career_stage')->>'min_years_since_phd' AS DOUBLE) IS NULL THEN 'career_stage' END, {_BAD.format('nationalities')}, CASE WHEN NOT {_ANY} THEN {_BAD.format('host_countries')} END], lambda x: x IS NOT NULL)) END AS problems FROM wh)
SELECT layer, file, id, category, CASE WHEN hosts IS NOT NULL THEN coalesce(list_aggregate(hosts, 'string_agg', ','), '') END AS hosts, host_anywhere, CASE WHEN nationalities IS NOT NULL THEN coalesce(list_aggregate(nationalities, 'string_agg', ','), '') END AS nationalities, min_years, max_years, phd_required, breaks_extend, CASE WHEN category = 'phd' THEN 'masters_student,phd_student' END AS levels, verified, custom, first_date, template,
  coalesce(list_aggregate(problems, 'string_agg', ', '), '') AS problems FROM ca"""
_PAPERS = f"""{_IDS} li AS ({r._duck(_LINES)}), fi AS ({r._duck(_FILES)}), wc AS (SELECT doc, sum(CASE WHEN is_heading THEN 0 ELSE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_''’-]*')) END)::BIGINT AS words FROM li GROUP BY doc),
sz AS (SELECT doc, pt, sum(chars)::BIGINT AS chars FROM li WHERE NOT raised AND chars > 0 GROUP BY doc, pt), ms AS (SELECT f.doc, kind, pages, side::DOUBLE AS side, error, coalesce(words, 0) AS words FROM fi f LEFT JOIN wc USING (doc)),
rq AS (SELECT {r._duck(_APP)} AS app, doc, doc % 4 AS j, doc % 7 > 0 AS attached FROM ids WHERE doc % 4 < 3), st AS (SELECT rq.app, CASE j WHEN 0 THEN 'Proposal' WHEN 1 THEN 'CV' ELSE 'Plan' END AS name, j, rq.doc, CASE WHEN NOT attached THEN 'not_attached' WHEN ms.doc IS NULL THEN 'not_found' WHEN error IS NOT NULL THEN 'unreadable' END AS state, ms.* EXCLUDE (doc) FROM rq LEFT JOIN ms ON ms.doc = rq.doc AND attached),
ok AS (SELECT * FROM st WHERE state IS NULL), sm AS (SELECT doc, sum(chars) AS total, coalesce(sum(chars) FILTER (pt < 9.75), 0) AS little, min(pt) AS least FROM sz GROUP BY doc),
se AS (SELECT app, name, doc, unnest(CASE j WHEN 0 THEN ['Aims of it', 'Ethical review', 'Budget'] WHEN 1 THEN [] ELSE ['methods'] END) AS section FROM ok),
fo AS (SELECT DISTINCT se.app, se.name, section FROM se JOIN li ON li.doc = se.doc WHERE li.text <> '' AND regexp_matches(lower(CASE WHEN is_heading THEN text ELSE left(text, 70) END), CASE section WHEN 'Aims of it' THEN '(?s)aims.*it' WHEN 'Ethical review' THEN '(?s)ethical.*review' WHEN 'Budget' THEN 'budget' ELSE 'methods' END))"""
QUERIES = {
    "src14_calls": (calls, _CALLS),
    "fel22_measured": (measured, f"{_PAPERS} SELECT doc::VARCHAR AS doc_id, kind, pages, words, coalesce((SELECT string_agg(pt::INTEGER || ':' || chars, ' ' ORDER BY pt) FROM sz WHERE sz.doc = ms.doc), '') AS sizes FROM ms"),
    "fel25_findings": (
        findings,
        f"""{_PAPERS} SELECT app, name, state AS rule, 'fail' AS outcome, CASE WHEN state = 'unreadable' THEN error ELSE '' END AS detail FROM st WHERE state IS NOT NULL
            UNION ALL SELECT app, name, 'format', CASE WHEN j = 0 THEN 'info' ELSE 'fail' END, CASE j WHEN 0 THEN 'pdf' ELSE 'docx' END FROM ok WHERE (j = 0 AND kind <> 'pdf') OR (j = 1 AND kind <> 'docx')
            UNION ALL SELECT app, name, 'pages', CASE WHEN pages IS NULL THEN 'warn' WHEN pages > 5 THEN 'fail' ELSE 'pass' END, concat_ws('/', pages::VARCHAR, '5') FROM ok WHERE j < 2 UNION ALL SELECT app, name, 'words', CASE WHEN words > 150 THEN 'fail' ELSE 'pass' END, words || '/150' FROM ok WHERE j <> 1
            UNION ALL SELECT app, name, 'text_size', CASE WHEN little = 0 THEN 'pass' WHEN little <= 0.02 * total THEN 'warn' ELSE 'fail' END, least::DOUBLE::VARCHAR FROM ok JOIN sm USING (doc) WHERE j < 2
            UNION ALL SELECT app, name, 'margins', CASE WHEN side < 1.95::DOUBLE THEN 'fail' ELSE 'pass' END, CASE WHEN side < 1.95::DOUBLE THEN 'left' ELSE '' END FROM ok WHERE j < 2
            UNION ALL SELECT app, name, 'section', CASE WHEN (app, name, section) IN (SELECT (app, name, section) FROM fo) THEN 'pass' ELSE 'fail' END, section FROM se""",
    ),
}
