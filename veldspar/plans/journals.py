"""Queries over journal profiles: three documents give a journal its file in three layers, and are held against what stands of it."""

from __future__ import annotations

from datetime import date

from veldspar.operators import journals as j

from . import references as r

TODAY = date(2026, 10, 1)
_FILE = "concat('j', CAST(CAST((doc - doc % 3) / 3 AS BIGINT) AS STRING), '.json')"
_RAW = f"""SELECT CAST(doc % 3 AS INT) AS layer, {_FILE} AS file, CASE WHEN doc % 11 = 0 THEN '{{"name": ' WHEN doc % 19 = 0 THEN '[1]' ELSE concat('{{"name": "Journal ', CAST(doc AS STRING), '", "limits": {{"figures": ', CASE WHEN doc % 13 = 5 THEN '"many"' ELSE CAST(doc % 9 AS STRING) END, ', "total_words": "', CAST(500 + doc % 7 AS STRING), '"}},
 "reference_style": "', CASE doc % 7 WHEN 0 THEN 'vancouver' WHEN 1 THEN '' WHEN 2 THEN ' Author_Year ' ELSE 'numbered' END, '", "verified": ', CASE doc % 5 WHEN 0 THEN 'null' WHEN 1 THEN CASE WHEN doc % 2 = 0 THEN '"2026-02-30"' ELSE '"2026-09-02"' END WHEN 2 THEN '"2026-08-01"' WHEN 3 THEN '"2026-01-15"' ELSE '"2025-06-30"' END,
 ', "template": ', CASE WHEN doc % 17 = 0 THEN 'true' ELSE 'false' END, CASE WHEN doc % 4 = 0 THEN '' ELSE concat(', "max_authors_listed": ', CAST(doc % 4 AS STRING)) END, ', "require_doi": ', CASE WHEN doc % 3 = 0 THEN 'true' ELSE 'false' END, CASE WHEN doc % 5 = 2 THEN '' ELSE ', "abstract_headings": ["Background", "Methods", "Aim (C++)"]' END,
 ', "required_sections": ["Data availability", "Author contributions", "Results"', CASE WHEN doc % 4 = 1 THEN ', "Ethics and consent"' ELSE '' END, ']', CASE WHEN doc % 6 = 1 THEN ', "notes": "Pre-filled"' WHEN doc % 6 = 2 THEN ', "notes": "Mind the size"' ELSE '' END, ', "article_type": "', CASE WHEN doc % 2 = 0 THEN '' ELSE 'Letter' END, '"}}') END AS content FROM ids"""
_LINES = """SELECT doc, i, concat(CASE WHEN i < 3 THEN CASE (doc + i) % 5 WHEN 0 THEN 'Background: ' WHEN 1 THEN 'So it is. methods - ' WHEN 2 THEN 'aim (c++). ' WHEN 3 THEN 'No Methods: ' ELSE '' END ELSE '' END, line) AS text, CASE WHEN i < 3 THEN 'abstract' WHEN doc % 10 = 0 THEN 'findings' ELSE 'results' END AS section, false AS is_heading FROM lines"""
_ADDED = """SELECT doc, n + 1 AS i, 'DATA AND CODE AVAILABILITY' AS text, 'methods' AS section, true AS is_heading FROM ids WHERE doc % 4 = 0 UNION ALL SELECT doc, n + 2, 'Author and editor contributions. One wrote, the other read.', 'back_matter', false FROM ids WHERE doc % 3 = 0
 UNION ALL SELECT doc, n + 3, 'The last words of this text say nothing of anything and go on and on for a while, ethics and consent', 'back_matter', false FROM ids WHERE doc % 2 = 0 UNION ALL SELECT doc, n + 4, 'Given', 'ethics_and_consent', false FROM ids WHERE doc % 8 = 1"""
_UNION = f"{_LINES} UNION ALL {_ADDED}"


def profiles(spark, sf_dir):
    raw = _RAW.replace("{", "{{").replace("}", "}}")  # braces of JSON, not of the statement's parameters
    return j.overlay(j.parsed(spark.sql(f"WITH {r._TABLES} {raw}", docs=r._docs(spark, sf_dir))))


def rules(spark, sf_dir):
    docs = spark.sql(f"WITH {r._TABLES} SELECT CAST(doc AS STRING) AS doc_id, {_FILE} AS file FROM ids", docs=r._docs(spark, sf_dir))
    return j.assigned(docs, profiles(spark, sf_dir))


def paragraphs(spark, sf_dir):
    return spark.sql(f"WITH {r._TABLES} SELECT CAST(doc AS STRING) AS doc_id, CAST(i AS INT) AS idx, text, section, is_heading FROM ({_UNION})", docs=r._docs(spark, sf_dir))


def stored(spark, sf_dir):
    return profiles(spark, sf_dir).selectExpr("file", "layer", "name", "limits['figures'] AS figures", "limits['total_words'] AS total_words", "reference_style", "max_authors_listed", "require_doi", "verified", "article_type", "size(required_sections) AS n_required", "size(abstract_headings) AS n_headings", "notes")


def journal_issues(spark, sf_dir):
    p, own = paragraphs(spark, sf_dir), rules(spark, sf_dir)
    return j.provenance(own, TODAY).unionByName(j.abstract_headings(p, own)).unionByName(j.required_sections(p, own))


def reference_issues(spark, sf_dir):
    p, held, found = r._both(spark, sf_dir)
    style = r.c.styles(held, r.c.numbers(p), r.c.cited(found), r.c.noted(p, r.notes(spark, sf_dir)))
    return j.reference_issues(held, rules(spark, sf_dir), style)


_DATE = "CASE WHEN regexp_full_match(verified0, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(verified0 AS DATE) END"
PROFILES = f"""rw AS ({r._duck(_RAW)}), va AS (SELECT layer, file, json(content) AS c FROM (SELECT layer, file, content FROM rw WHERE json_valid(content)) WHERE json_type(content) = 'OBJECT'),
pf AS (SELECT layer, file, coalesce(nullif(trim(c->>'name'), ''), replace(file, '.json', '')) AS name, c->'limits'->>'figures' AS f0, c->'limits'->>'total_words' AS t0, nullif(lower(trim(coalesce(c->>'reference_style', ''))), '') AS reference_style, nullif(trim(coalesce(c->>'verified', '')), '') AS verified0, coalesce(c->>'template', 'false') = 'true' AS template,
 CAST(c->>'max_authors_listed' AS INTEGER) AS max_authors_listed, c->>'require_doi' = 'true' AS require_doi, coalesce(CAST(c->'abstract_headings' AS VARCHAR[]), []) AS abstract_headings, coalesce(CAST(c->'required_sections' AS VARCHAR[]), []) AS required_sections, c->>'notes' AS notes, nullif(trim(c->>'article_type'), '') AS article_type FROM va),
us AS (SELECT *, {_DATE} AS verified FROM pf WHERE NOT template AND (reference_style IS NULL OR reference_style IN ('numbered', 'author_year')) AND (verified0 IS NULL OR {_DATE} IS NOT NULL) AND try_cast(f0 AS INTEGER) IS NOT NULL),
pr AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY file ORDER BY layer) = 1), ru AS (SELECT CAST(doc AS VARCHAR) AS doc_id, pr.* FROM ids JOIN pr ON pr.file = {r._duck(_FILE)}),
"""
_IDS = r.P[: r.P.index("p AS (")]
_SEVERITY = "CASE WHEN verified IS NULL THEN 'warning' ELSE 'error' END"
_NO_AUTHORS = r"et al"
#: Authors one after another from the start of an entry.
_AUTHOR = r"[A-ZÀ-ɏ][A-Za-zÀ-ɏ''’-]{1,24}(?:\s+[A-Z][a-z]+)?,?\s+[A-Z]\.?(?:\s*[A-Z]\.?){0,3}"
_PREFIX = rf"^{_AUTHOR}(?:(?:\s*[,;&]\s*|\s+and\s+)+{_AUTHOR})*"
_ALIKE = f"""CASE WHEN contains(lower(left(text, 220)), 'et al') THEN NULL ELSE nullif(len(regexp_extract_all(regexp_extract(text, '{_PREFIX}'), '{_AUTHOR}')), 0) END"""


def _over(code: str, lead: str, rows: str) -> str:
    return f"""SELECT doc_id, '{code}' AS code, min(idx) AS idx, {lead} || ': ' || list_aggregate(list_transform(list(place ORDER BY place)[1:12], lambda x: x::VARCHAR), 'string_agg', ', ') || CASE WHEN count(*) > 12 THEN ' and ' || (count(*) - 12) || ' more' ELSE '' END AS detail FROM ({rows}) GROUP BY doc_id{', max_authors_listed' if 'max' in lead else ''}"""


QUERIES = {
    "src12_profiles": (stored, f"{_IDS}{PROFILES} z AS (SELECT 1) SELECT file, layer, name, f0::INTEGER AS figures, t0::INTEGER AS total_words, reference_style, max_authors_listed, require_doi, verified, article_type, len(required_sections)::INTEGER AS n_required, len(abstract_headings)::INTEGER AS n_headings, notes FROM pr"),
    "sub02_journal": (
        journal_issues,
        f"""{_IDS}{PROFILES} p AS (SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS idx, text, section, is_heading FROM ({r._duck(_UNION)})), ag AS (SELECT *, CAST(DATE '2026-10-01' - verified AS DOUBLE) / 30.44 AS age FROM ru),
            ab AS (SELECT doc_id, min(idx) AS idx, string_agg(text, chr(10) ORDER BY idx) AS text FROM p WHERE section = 'abstract' AND text <> '' GROUP BY doc_id),
            la AS (SELECT ru.doc_id, ab.idx, verified, list_filter(abstract_headings, lambda h: NOT regexp_matches(ab.text, '(?i)(?:^|\\n|\\.\\s)\\s*' || regexp_escape(h) || '\\s*[:.–—\\n-]')) AS lacking FROM ru JOIN ab USING (doc_id)),
            wa AS (SELECT doc_id, verified, unnest(list_distinct(required_sections)) AS q FROM ru), ca AS (SELECT doc_id, section, lower(CASE WHEN is_heading THEN text ELSE left(text, 70) END) AS said FROM p WHERE text <> ''),
            ok AS (SELECT DISTINCT wa.doc_id, q FROM wa JOIN ca USING (doc_id) WHERE section = replace(lower(q), ' ', '_') OR regexp_matches(said, '(?s)' || list_aggregate(list_filter(string_split(lower(q), ' '), lambda w: w NOT IN ('and', 'of', 'the')), 'string_agg', '.*')))
            SELECT doc_id, 'submission' AS "check", severity, code, CAST(idx AS INTEGER) AS para_index, detail FROM (
              SELECT doc_id, 'info' AS severity, 'checked_against' AS code, NULL AS idx, concat_ws('; ', concat_ws(' · ', name, article_type), verified::VARCHAR) AS detail FROM ag UNION ALL SELECT doc_id, 'warning', 'unverified', NULL, name FROM ag WHERE verified IS NULL
              UNION ALL SELECT doc_id, 'warning', 'out_of_date', NULL, name || ' ' || floor(age)::BIGINT FROM ag WHERE age > 12 UNION ALL SELECT doc_id, 'info', 'worth_confirming', NULL, name || ' ' || floor(age)::BIGINT FROM ag WHERE age > 6 AND age <= 12
              UNION ALL SELECT doc_id, 'info', 'notes', NULL, notes FROM ag WHERE notes IS NOT NULL AND NOT (verified IS NULL AND starts_with(notes, 'Pre-filled'))
              UNION ALL SELECT doc_id, {_SEVERITY}, 'abstract_headings', idx, list_aggregate(lacking, 'string_agg', ', ') FROM la WHERE len(lacking) > 0 UNION ALL SELECT doc_id, {_SEVERITY}, 'required_section', NULL, q FROM wa WHERE (doc_id, q) NOT IN (SELECT (doc_id, q) FROM ok))""",
    ),
    "ref16_journal": (
        reference_issues,
        r.QUERIES["ext21_styles"][1].replace("SELECT doc_id, CASE WHEN best = 0", f", {PROFILES} sy AS (SELECT doc_id, CASE WHEN best = 0")
        + f"""), us2 AS (SELECT sy.doc_id, CASE style WHEN 'unknown' THEN NULL WHEN 'numeric' THEN 'numbered' ELSE 'author_year' END AS used, h.idx FROM sy JOIN (SELECT doc_id, min(idx) AS idx FROM hb GROUP BY 1) h USING (doc_id)),
            au AS (SELECT doc_id, place, idx, {_ALIKE} AS n, nullif(regexp_extract(text, '(?i)(10\\.[^ ]+)', 1), '') AS doi FROM hb)
            SELECT doc_id, 'references' AS "check", 'warning' AS severity, code, CAST(idx AS INTEGER) AS para_index, detail FROM (
              SELECT doc_id, 'journal_style' AS code, idx, used || ' instead of ' || reference_style AS detail FROM us2 JOIN ru USING (doc_id) WHERE used <> reference_style
              UNION ALL {_over("too_many_authors", "max_authors_listed", "SELECT * FROM au JOIN ru USING (doc_id) WHERE n > max_authors_listed")} UNION ALL {_over("doi_required", "'none'", "SELECT * FROM au JOIN ru USING (doc_id) WHERE require_doi AND doi IS NULL")})""",
    ),
}
