"""Queries over manuscripts: every document's lines as paragraphs, with phrases planted by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import manuscripts as m

_S = "CASE WHEN i = 0 THEN 'abstract' WHEN i % 4 = 1 THEN 'introduction' WHEN i % 4 = 2 THEN 'methods' WHEN i % 4 = 3 THEN 'results' ELSE 'discussion' END"
#: Phrases by (document + line) modulo 12; both engines read the same expression.
_P = """CASE (doc + i) % 12 WHEN 0 THEN concat(' as in Fig. ', CAST((doc + 2 * i) % 6 + 1 AS STRING), '.') WHEN 1 THEN concat(' (Figure ', CAST((doc * 3 + i) % 5 + 1 AS STRING), ')') WHEN 2 THEN concat(' in Table ', CAST(doc % 3 + 1 AS STRING), ' here')
 WHEN 3 THEN concat(' as known [', CAST((doc + i) % 9 + 1 AS STRING), '].') WHEN 4 THEN concat(' was shown [', CAST(doc % 4 + 1 AS STRING), '-', CAST(doc % 4 + 3 AS STRING), ', 8].') WHEN 5 THEN ' the polymerase chain reaction (PCR) was run'
 WHEN 6 THEN ' then PCR and QZX and RNA were used' WHEN 7 THEN CASE WHEN doc % 2 = 0 THEN ' with 5 mg, then 10mg.' ELSE ' with 5 ml of 7 mL.' END WHEN 8 THEN CASE WHEN doc % 3 = 0 THEN ' the colour and behaviour' ELSE ' the color of fiber' END
 WHEN 9 THEN ' in patients and patients with mice' WHEN 10 THEN ' by Homo sapiens or H. sapiens' ELSE CASE WHEN doc % 5 = 0 THEN ' after informed consent. 12 were left' ELSE ' in Figs. 1-3 and more' END END"""
_BASE = "SELECT doc, i, concat(line, {p}) AS text, {s} AS section FROM lines".format(p=_P, s=_S)
_LEGENDS = "SELECT doc, greatest(1000, n) + k AS i, concat('Figure ', CAST(CASE WHEN k = 4 AND doc % 7 = 0 THEN 1 ELSE k END AS STRING), '. Title (A) and (B) of it') AS text, 'figure_legends' AS section FROM ids, ks WHERE k <= doc % 5"
_REFS = """SELECT doc, greatest(2000, n + 1000) + k AS i, concat(CAST(CASE WHEN k = 3 AND doc % 6 = 0 THEN 4 ELSE k END AS STRING), '. Smith A, Jones B. A title of number ', CAST(CASE WHEN doc % 9 = 0 THEN 1 ELSE k END AS STRING), '. Journal',
 CASE WHEN k = 2 THEN ' in press' ELSE concat(' ', CAST(1990 + k AS STRING)) END, CASE WHEN k % 2 = 1 THEN concat(' doi:', CASE WHEN k = 5 THEN '11' ELSE '10' END, '.1234/abc', CAST(k AS STRING)) ELSE '' END, '.') AS text, 'references' AS section FROM ids, ks WHERE k <= doc % 8"""
#: Every line; legends and references come after the last one.
_UNION = f"{_BASE} UNION ALL {_LEGENDS} UNION ALL {_REFS}"


def paragraphs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    sql = f"""WITH lines AS (SELECT doc_id AS doc, i, line FROM {{docs}} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) t AS i, line), ids AS (SELECT doc_id AS doc, size(split(coalesce(text, ''), '\\n')) AS n FROM {{docs}}), ks AS (SELECT CAST(id AS INT) AS k FROM range(1, 9))
        SELECT CAST(doc AS STRING) AS doc_id, CAST(i AS INT) AS idx, text, section, false AS is_heading FROM ({_UNION})"""
    return spark.sql(sql, docs=docs)


P = f"""WITH lines AS (SELECT doc_id AS doc, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL), ids AS (SELECT doc_id AS doc, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL), ks AS (SELECT CAST(range AS INTEGER) AS k FROM range(1, 9)),
p AS (SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS idx, text, section FROM ({_UNION.replace('AS STRING', 'AS VARCHAR')})), b AS (SELECT * FROM p WHERE section <> 'references'),
lg AS (SELECT doc_id, idx, text, CAST(regexp_extract(text, '^Figure ([0-9]+)', 1) AS INTEGER) AS number, row_number() OVER (PARTITION BY doc_id, regexp_extract(text, '^Figure ([0-9]+)', 1) ORDER BY idx) AS n FROM p WHERE regexp_matches(text, '^Figure [0-9]+\\. [A-Z]')),
cm AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, '(?:^|[ (])(?:Figures?|Figs?\\.|Tables?) [0-9]+(?:-[0-9]+)?')) AS c FROM b WHERE section <> 'figure_legends'),
ce AS (SELECT doc_id, idx, CASE WHEN contains(c, 'Table') THEN 'table' ELSE 'figure' END AS kind, CAST(regexp_extract(c, '([0-9]+)', 1) AS INTEGER) AS lo, CAST(coalesce(nullif(regexp_extract(c, '-([0-9]+)', 1), ''), regexp_extract(c, '([0-9]+)', 1)) AS INTEGER) AS hi, contains(c, 'Fig.') OR contains(c, 'Figs.') AS short FROM cm),
ca AS (SELECT doc_id, idx, kind, short, unnest(range(lo, hi + 1)) AS number FROM ce), fc AS (SELECT doc_id, kind, CAST(number AS INTEGER) AS number, min(idx) AS idx FROM ca GROUP BY 1, 2, 3),
en AS (SELECT doc_id, idx, text, CAST(regexp_extract(text, '^([0-9]+)', 1) AS INTEGER) AS stated, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place, nullif(regexp_extract(text, '((?:18|19|20)[0-9][0-9])', 1), '') AS year,
  nullif(rtrim(regexp_extract(text, 'doi:([^ ]+)', 1), '.'), '') AS doi, left(regexp_replace(lower(regexp_replace(text, '^[0-9]+\\. ', '')), '[^a-z0-9]', '', 'g'), 90) AS key FROM p WHERE section = 'references'),
cb AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, '\\[[0-9-]+(?:, [0-9]+)*\\]')) AS c FROM b), cp AS (SELECT doc_id, idx, unnest(string_split(regexp_replace(c, '[\\[\\] ]', '', 'g'), ',')) AS piece, unnest(range(len(string_split(c, ',')))) AS part FROM cb),
nc AS (SELECT doc_id, idx, part, CAST(unnest(range(CAST(string_split(piece, '-')[1] AS INTEGER), CAST(string_split(piece, '-')[-1] AS INTEGER) + 1)) AS INTEGER) AS number FROM cp),
nf AS (SELECT doc_id, number, min(idx) AS idx, arg_min(part, idx * 10 + part) AS part FROM nc GROUP BY 1, 2)"""


def _sql(check, severity, code, select, para="idx"):
    return f"{P} SELECT doc_id, '{check}' AS \"check\", '{severity}' AS severity, '{code}' AS code, CAST({para} AS INTEGER) AS para_index, CAST(detail AS VARCHAR) AS detail FROM ({select})"


_ISSUES = {
    "fig01_duplicate_legend": ("figures", "duplicate_legend", "warning", "SELECT doc_id, idx, concat('figure main ', number) AS detail FROM lg WHERE n > 1", "idx"),
    "fig03_no_legend": ("figures", "no_legend", "error", "SELECT doc_id, idx, concat('figure main ', number) AS detail FROM fc WHERE kind = 'figure' AND doc_id IN (SELECT doc_id FROM lg) AND (doc_id, number) NOT IN (SELECT (doc_id, number) FROM lg)", "idx"),
    "fig04_no_legends": ("figures", "no_legends_at_all", "info", "SELECT doc_id, concat(kind, ' ', count(*)) AS detail FROM fc WHERE kind = 'table' OR doc_id NOT IN (SELECT doc_id FROM lg) GROUP BY doc_id, kind", "NULL"),
    "fig05_never_cited": ("figures", "never_cited", "error", "SELECT doc_id, idx, concat('figure main ', number) AS detail FROM lg WHERE n = 1 AND (doc_id, number) NOT IN (SELECT (doc_id, number) FROM fc WHERE kind = 'figure')", "idx"),
    "fig06_numbering": ("figures", "numbering", "warning", "SELECT doc_id, concat('figure main ', number) AS detail FROM (SELECT doc_id, number, coalesce(lag(number) OVER (PARTITION BY doc_id ORDER BY number), 0) AS before FROM lg WHERE n = 1) WHERE number <> before + 1", "NULL"),
    "fig07_order": ("figures", "citation_order", "warning", "SELECT a.doc_id, a.idx, concat(a.kind, ' main ', a.number, ' before ', min(c.number)) AS detail FROM fc a JOIN fc c ON a.doc_id = c.doc_id AND a.kind = c.kind AND c.number < a.number AND c.idx > a.idx GROUP BY a.doc_id, a.idx, a.kind, a.number", "idx"),
    "fig10_mixed_names": ("figures", "mixed_names", "info", "SELECT doc_id, concat(count(*) FILTER (short), '/', count(*)) AS detail FROM ca WHERE kind = 'figure' GROUP BY doc_id HAVING bool_or(short) AND NOT bool_and(short)", "NULL"),
    "ref01_no_list": ("references", "no_list", "info", "SELECT doc_id, count(*) AS detail FROM nc WHERE doc_id NOT IN (SELECT doc_id FROM en) GROUP BY doc_id", "NULL"),
    "ref03_no_reference": ("references", "no_reference", "error", "SELECT doc_id, idx, number AS detail FROM nf WHERE doc_id IN (SELECT doc_id FROM en) AND (doc_id, number) NOT IN (SELECT (doc_id, stated) FROM en)", "idx"),
    "ref04_never_cited": ("references", "never_cited", "error", "SELECT doc_id, idx, stated AS detail FROM en WHERE doc_id IN (SELECT doc_id FROM nc) AND (doc_id, stated) NOT IN (SELECT (doc_id, number) FROM nf)", "idx"),
    "ref05_order": ("references", "citation_order", "warning", "SELECT doc_id, idx, concat(number, ' after ', before) AS detail FROM (SELECT *, max(number) OVER (PARTITION BY doc_id ORDER BY idx, part, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM nf) WHERE number < before", "idx"),
    "ref09_numbering": ("references", "numbering", "warning", "SELECT doc_id, idx, stated AS detail FROM (SELECT *, lag(stated) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM en) WHERE stated <> before + 1", "idx"),
    "ref10_duplicates": ("references", "duplicate_entry", "warning", "SELECT doc_id, idx, concat(place, '=', first) AS detail FROM (SELECT *, min(place) OVER (PARTITION BY doc_id, key) AS first FROM en) WHERE place <> first", "idx"),
    "ref13_no_year": ("references", "no_year", "info", "SELECT doc_id, count(*) FILTER (year IS NULL) AS detail FROM en GROUP BY doc_id HAVING count(*) FILTER (year IS NULL) BETWEEN 1 AND greatest(3, 0.2 * count(*))", "NULL"),
    "ref14_doi_coverage": ("references", "doi_coverage", "info", "SELECT doc_id, concat(count(doi), '/', count(*)) AS detail FROM en GROUP BY doc_id HAVING count(doi) < count(*) AND 2 * count(doi) >= count(*)", "NULL"),
    "ref15_bad_doi": ("references", "bad_doi", "warning", "SELECT doc_id, idx, doi AS detail FROM en WHERE doi IS NOT NULL AND NOT regexp_matches(doi, '^10\\.[0-9]{4,9}/.+')", "idx"),
    "con02_unit_capitals": ("consistency", "unit_capitals", "warning", "SELECT doc_id, 'mL/ml' AS detail FROM b GROUP BY doc_id HAVING bool_or(contains(text, ' 5 ml of 7 mL.'))", "NULL"),
    "con01_unit_spacing": ("consistency", "unit_spacing", "warning", "SELECT doc_id, concat('mg tight ', sum(CASE WHEN contains(text, ' with 5 mg, then 10mg.') THEN 1 END)) AS detail FROM b GROUP BY doc_id HAVING bool_or(contains(text, ' with 5 mg, then 10mg.'))", "NULL"),
    "stm01_human_ethics": ("statements", "human_ethics", "warning", "SELECT doc_id, 2 * sum(CASE WHEN contains(text, ' in patients and patients') THEN 1 ELSE 0 END) AS detail FROM b GROUP BY doc_id HAVING detail >= 2", "NULL"),
    "stm01_human_consent": ("statements", "human_consent", "warning", "SELECT doc_id, 2 * sum(CASE WHEN contains(text, ' in patients and patients') THEN 1 ELSE 0 END) AS detail FROM b GROUP BY doc_id HAVING detail >= 2 AND NOT bool_or(contains(text, 'informed consent'))", "NULL"),
    "stm02_animal_ethics": ("statements", "animal_ethics", "warning", "SELECT doc_id, sum(CASE WHEN contains(text, ' with mice') THEN 1 ELSE 0 END) AS detail FROM b GROUP BY doc_id HAVING detail >= 2", "NULL"),
    "stm03_missing": ("statements", "missing_statements", "info", "SELECT doc_id, 'data_availability,funding,interests,contributions' AS detail FROM b GROUP BY doc_id", "NULL"),
    "abb01_used_before": ("abbreviations", "used_before_defined", "warning", "SELECT doc_id, min(idx) FILTER (contains(text, ' then PCR and')) AS idx, 'PCR' AS detail FROM b GROUP BY doc_id HAVING min(idx) FILTER (contains(text, ' then PCR and')) < min(idx) FILTER (contains(text, ' (PCR) was'))", "idx"),
    "abb02_defined_twice": ("abbreviations", "defined_twice", "warning", "SELECT doc_id, min(idx) AS idx, concat('PCR ', zone, ' ', count(*)) AS detail FROM (SELECT *, CASE section WHEN 'abstract' THEN 'abstract' WHEN 'methods' THEN 'methods' ELSE 'main' END AS zone FROM b WHERE contains(text, ' (PCR) was')) GROUP BY doc_id, zone HAVING count(*) > 1", "idx"),
    "abb04_never_used": ("abbreviations", "never_used", "info", "SELECT doc_id, min(idx) FILTER (contains(text, ' (PCR) was')) AS idx, 'PCR' AS detail FROM b GROUP BY doc_id HAVING bool_or(contains(text, ' (PCR) was')) AND NOT bool_or(contains(text, ' then PCR and'))", "idx"),
    "spc03_full_again": ("species", "full_again", "info", "SELECT doc_id, min(idx) AS idx, concat('Homo sapiens ', count(*)) AS detail FROM b WHERE contains(text, ' by Homo sapiens') GROUP BY doc_id HAVING count(*) > 1", "idx"),
}


def _issue(check, code):
    if check == "species":
        return lambda s, d: m.species_issues(paragraphs(s, d), ["Homo", "Mus"])[code]
    return lambda s, d: m.CHECKS[check](paragraphs(s, d))[code]


QUERIES = {name: (_issue(check, code), _sql(check, severity, code, select, para)) for name, (check, code, severity, select, para) in _ISSUES.items()}
QUERIES |= {
    "ext01_callouts": (lambda s, d: m.callouts(paragraphs(s, d)).groupBy("doc_id", "kind", "number").agg(F.count("*").alias("n")), f"{P} SELECT doc_id, kind, CAST(number AS INTEGER) AS number, count(*) AS n FROM ca GROUP BY 1, 2, 3"),
    "ext04_legends": (lambda s, d: m.legends(paragraphs(s, d)).select("doc_id", "idx", "number", "n"), f"{P} SELECT doc_id, idx, number, CAST(n AS INTEGER) AS n FROM lg"),
    "ext06_legend_panels": (lambda s, d: m.legend_panels(paragraphs(s, d)).select("doc_id", "number", F.array_join("panels", "").alias("panels")), f"{P} SELECT doc_id, number, 'AB' AS panels FROM lg WHERE n = 1"),
    "ext07_entries": (lambda s, d: m.entries(paragraphs(s, d)).select("doc_id", "place", "stated", "year", "doi", "key"), f"{P} SELECT doc_id, CAST(place AS INTEGER) AS place, stated, year, doi, key FROM en"),
    "ext18_numeric": (lambda s, d: m.numeric_citations(paragraphs(s, d)).groupBy("doc_id", "number").agg(F.count("*").alias("n")), f"{P} SELECT doc_id, number, count(*) AS n FROM nc GROUP BY 1, 2"),
    "con04_spellings": (
        lambda s, d: m.spellings(paragraphs(s, d)),
        f"""{P} SELECT doc_id, family, count(*) FILTER (british) AS british, count(*) FILTER (NOT british) AS american FROM (SELECT doc_id, unnest(CASE WHEN contains(text, ' the colour and behaviour') THEN ['colour', 'behaviour'] WHEN contains(text, ' the color of fiber') THEN ['colour', 'fibre'] ELSE [] END) AS family,
            contains(text, ' the colour and behaviour') AS british FROM b) GROUP BY 1, 2""",
    ),
    "sub01_sizes": (lambda s, d: m.sizes(paragraphs(s, d)).select("doc_id", "figures", "tables", "entries"), f"{P} SELECT doc_id, coalesce(f, 0) AS figures, CAST(0 AS BIGINT) AS tables, coalesce(e, 0) AS entries FROM (SELECT DISTINCT doc_id FROM p) LEFT JOIN (SELECT doc_id, count(*) AS f FROM lg WHERE n = 1 GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS e FROM en GROUP BY 1) USING (doc_id)"),
    "sub03_limits": (lambda s, d: m.limit_issues(paragraphs(s, d), {"figures": 2, "entries": 4}), None),
    "sub05_sections": (lambda s, d: m.missing_sections(paragraphs(s, d), ["abstract", "methods", "references"]), _sql("submission", "warning", "missing_section", "SELECT doc_id, s AS detail FROM (SELECT DISTINCT doc_id FROM p), (VALUES ('abstract'), ('methods'), ('references')) t(s) WHERE (doc_id, s) NOT IN (SELECT (doc_id, section) FROM p)", "NULL")),
    "ext38_crossing": (lambda s, d: m.crossing(paragraphs(s, d), 250), None),
    "ext16_names": (lambda s, d: m.name_citations(paragraphs(s, d)), None),
    "ext21_style": (lambda s, d: m.style(paragraphs(s, d)), f"{P} SELECT DISTINCT doc_id, 'numeric' AS style FROM nc"),
    "run01_all": (lambda s, d: m.run(paragraphs(s, d)).groupBy("check", "severity").agg(F.count("*").alias("n")), None),
    "cmp01_changes": (lambda s, d: m.changes(paragraphs(s, d), paragraphs(s, d).withColumn("text", F.regexp_replace("text", "patients", "volunteers and patients"))), None),
}
