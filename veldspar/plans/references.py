"""Queries over reference lists: every document's lines as paragraphs, cited by number, name, key or note as its id says.

The paragraphs are one expression that both engines read; citations in it break over lines, and entries come after the last line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import citations as c

_NAMES = "Adler Byrne Costa Duval Ekman Fischer".split()


def _name(n: str, left: int | None = None) -> str:
    return f"CASE ({n}) % 6 " + " ".join(f"WHEN {k} THEN '{x[:left]}'" for k, x in enumerate(_NAMES)) + " END"


_YEAR = "CAST(1990 + ({}) % 9 AS STRING)"
_Y2 = "CAST(90 + ({}) % 9 AS STRING)"
#: What a line ends with, by style (document modulo 6) and place; in brackets what the next one begins with.
_END = f"""CASE doc % 6
 WHEN 0 THEN CASE (doc + i) % 6 WHEN 0 THEN concat(' as known [', CAST((doc + i) % 9 + 1 AS STRING), ', ', CAST(i % 3 + 2 AS STRING), '-', CAST(i % 3 + 4 AS STRING), ']') WHEN 1 THEN concat(' (', CAST(i % 15 + 1 AS STRING), ')') WHEN 2 THEN ' raised12,3' WHEN 3 THEN ' [7; 5]' ELSE '' END
 WHEN 1 THEN CASE (doc + i) % 6 WHEN 0 THEN concat(' (', {_name('i')}, ' and ', {_name('i + 2')}, ' ', {_YEAR.format('i')}, '; ', {_name('i + 1')}, ' ', {_YEAR.format('doc + i')}, 'a)') WHEN 1 THEN concat(' (see ', {_name('doc + i')}, ' &')
  WHEN 2 THEN concat(' by ', {_name('doc')}, ' et al. (', {_YEAR.format('i + 1')}, ')') WHEN 3 THEN concat(' [Table ', {_name('i + 3')}, ' ', {_YEAR.format('i + 2')}, ']') WHEN 4 THEN ' (Figure 1991 only)' ELSE '' END
 WHEN 2 THEN CASE (doc + i) % 6 WHEN 0 THEN concat(' in [', {_name('i', 3)}, {_Y2.format('i')}, ']') WHEN 1 THEN concat(' see [', {_name('doc + i', 3)}, {_Y2.format('i')}, ',') WHEN 2 THEN ' of [ABK+95; NoDigit]' WHEN 3 THEN concat(' [', {_name('i')}, {_YEAR.format('i')}, ']')
  WHEN 4 THEN concat(' [', {_name('doc + i', 3)}, {_name('doc + i + 2', 3)}, {_YEAR.format('doc')}, ']') ELSE '' END
 WHEN 4 THEN CASE (doc + i) % 6 WHEN 0 THEN ' [Adl91]' WHEN 1 THEN ' [2]' WHEN 2 THEN ' (Adler 1991)' ELSE '' END ELSE '' END"""
_START = f"""CASE WHEN i > 0 AND (doc + i - 1) % 6 = 1 THEN CASE doc % 6 WHEN 1 THEN concat({_name('doc + i + 1')}, ', ', {_YEAR.format('i')}, ') ') WHEN 2 THEN concat({_name('i', 3)}, {_Y2.format('doc')}, '] ') ELSE '' END ELSE '' END"""
_SECTION = "CASE WHEN i % 3 = 0 THEN 'introduction' WHEN i % 3 = 1 THEN 'results' ELSE 'a heading of their own' END"
_BODY = f"SELECT doc, i, concat({_START}, line, {_END}) AS text, {_SECTION} AS section, CASE WHEN doc % 6 = 0 AND (doc + i) % 6 = 2 THEN length(line) + 7 END AS raised, CASE WHEN doc % 6 = 3 AND i % 3 = 0 THEN i % 7 END AS note FROM lines"
_ENTRIES = f"""SELECT doc, greatest(2000, n + 1000) + k AS i, concat(CASE WHEN doc % 6 IN (0, 4) THEN concat(CAST(k AS STRING), '. ') ELSE '' END, CASE WHEN k = 7 THEN 'A long account of how small things move in water' ELSE concat({_name('doc + k')}, ' J', CASE WHEN k % 3 > 0 THEN concat(', ', {_name('doc + k + 2')}, ' K. L.') ELSE '' END,
 CASE WHEN k % 4 = 1 THEN ', Grant M, Hughes N, Ito P' ELSE '' END) END, '. A study of matter number ', CAST(k AS STRING), ' in its field', CASE WHEN k % 5 = 0 THEN '' ELSE '. Journal 12(3):45' END, CASE WHEN k % 2 = 1 THEN ' doi:10.1234/abc' ELSE '' END, CASE WHEN k = 8 THEN '' ELSE concat(' (', {_YEAR.format('k')}, ')') END, '.') AS text,
 'references' AS section, CAST(NULL AS INT) AS raised, CAST(NULL AS INT) AS note FROM ids, ks WHERE k <= doc % 9"""
_UNION = f"{_BODY} UNION ALL {_ENTRIES}"
#: Notes by number modulo 7; every other document has an endnote of a footnote's number.
_NOTES = f"""SELECT doc, k AS note_id, concat('See ', {_name('doc + k')}, ' J, A study of matter', CASE WHEN k = 6 THEN '' ELSE concat(', ', {_YEAR.format('k')}) END) AS text, 'footnote' AS kind FROM ids, ks WHERE k <= 6 UNION ALL
 SELECT doc, 2 AS note_id, 'So Zimmer says in 1999' AS text, 'endnote' AS kind FROM ids WHERE doc % 4 = 1"""
_TABLES = """lines AS (SELECT doc_id AS doc, i, line FROM {docs} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) t AS i, line), ids AS (SELECT doc_id AS doc, size(split(coalesce(text, ''), '\\n')) AS n FROM {docs}), ks AS (SELECT CAST(id AS INT) AS k FROM range(1, 9))"""


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")


def paragraphs(spark, sf_dir):
    spans = "CASE WHEN raised IS NULL THEN array() ELSE array(named_struct('start', raised, 'end', raised + 4)) END AS superscript_spans, CASE WHEN note IS NULL THEN array() ELSE array(note) END AS footnote_ids"
    return spark.sql(f"WITH {_TABLES} SELECT CAST(doc AS STRING) AS doc_id, CAST(i AS INT) AS idx, text, section, false AS is_heading, {spans} FROM ({_UNION})", docs=_docs(spark, sf_dir))


def notes(spark, sf_dir):
    return spark.sql(f"WITH {_TABLES} SELECT CAST(doc AS STRING) AS doc_id, note_id, text, kind FROM ({_NOTES})", docs=_docs(spark, sf_dir))


def _both(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    return p, c.listed(p), c.worded(p)


def located(spark, sf_dir):
    return c.worded(paragraphs(spark, sf_dir))


def entry_keys(spark, sf_dir):
    return c.entry_keys(c.listed(paragraphs(spark, sf_dir)))


def styles(spark, sf_dir):
    p, held, found = _both(spark, sf_dir)
    return c.styles(held, c.numbers(p), c.cited(found), c.noted(p, notes(spark, sf_dir)))


def key_issues(spark, sf_dir):
    """Key issues of every document that has a list: what REF-06 says where the style is by key, for any style."""
    p = paragraphs(spark, sf_dir)
    held, found = c.listed(p), c.located(p, {"keys": c.KEYS})
    return c.key_issues(held, c.keys(found).join(held.select("doc_id").distinct(), "doc_id", "left_semi"))


def name_issues(spark, sf_dir):
    p, held, found = _both(spark, sf_dir)
    with_list = lambda df: df.join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    return c.name_issues(held, with_list(c.names(found))).unionByName(c.name_issues(held, with_list(c.noted(p, notes(spark, sf_dir))), "note"))


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


_W = r"[^\p{L}\p{N}_]"
_DATED = r"(?:{0}{{0,199}}{1})?(?:18|19|20)[0-9]{{2}}[a-z]?(?:{1}{0}{{0,39}})?"
_RX = {
    "keys": c.KEYS,
    "round": rf"\({_DATED.format('[^()]', '[^()\\p{L}\\p{N}_]')}\)",
    "square": rf"\[{_DATED.format(r'[^\[\]]', r'[^\[\]\p{L}\p{N}_]')}\]",
    "narrative": c.NARRATIVE.replace(r"(?<![\p{L}\p{N}_])", ""),
}
_SUR = rf"(?:^|{_W})([A-Z][A-Za-zÀ-ɏ'’-]{{1,25}})"
_Y = rf"(?:^|{_W})((?:18|19|20)[0-9]{{2}})[a-z]?(?:$|{_W})"
_q = lambda rx: rx.replace("'", "''")
_STOP = "[" + ", ".join(f"'{x}'" for x in c.NO_SURNAMES) + "]"
_sur = lambda x: f"list_filter(regexp_extract_all({x}, '{_q(_SUR)}', 1), lambda s: NOT list_contains({_STOP}, s))"
_RXS = "(VALUES " + ", ".join(f"('{k}', '{_q(rx)}')" for k, rx in _RX.items()) + ") r(kind, rx)"
P = f"""WITH lines AS (SELECT doc_id AS doc, CAST(unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS INTEGER) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL), ids AS (SELECT doc_id AS doc, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL),
ks AS (SELECT CAST(range AS INTEGER) AS k FROM range(1, 9)), p AS (SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS idx, text, section, raised, note FROM ({_duck(_UNION)})), b AS (SELECT * FROM p WHERE section <> 'references' AND text <> ''),
st AS (SELECT doc_id, idx, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - length(text) - 1 AS start FROM b), jo AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) || ' ' AS joined FROM b GROUP BY doc_id),
"""


def _matches() -> str:
    """Matches with offsets, one branch for each pattern (a pattern must be a constant)."""
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, list_transform(string_split_regex(joined, '{_q(rx)}'), lambda x: length(x)) AS gaps, regexp_extract_all(joined, '{_q(rx)}') AS found FROM jo" for k, rx in _RX.items())
    return f"""me AS ({each}), mu AS (SELECT doc_id, kind, gaps, found, unnest(range(1, len(found) + 1)) AS k FROM me),
mt AS (SELECT doc_id, kind, CAST(list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, found[k] AS match FROM mu),
fo AS (SELECT t.doc_id, t.kind, t.pos, s.idx, CAST(t.pos - s.start AS INTEGER) AS start, t.match FROM mt t ASOF JOIN st s ON t.doc_id = s.doc_id AND t.pos >= s.start),
"""


_KEYS = """kc AS (SELECT doc_id, pos, idx, unnest(range(len(string_split_regex(match, '[,;]')))) AS part, trim(unnest(string_split_regex(match[2:-2], '[,;]'))) AS key FROM fo WHERE kind = 'keys'), ke AS (SELECT * FROM kc WHERE regexp_matches(key, '[0-9]')),
"""
_NAMED = f"""nb AS (SELECT doc_id, idx, pos, unnest(string_split(match[2:-2], ';')) AS piece, unnest(range(len(string_split(match, ';')))) AS part FROM fo WHERE kind IN ('round', 'square')),
nx AS (SELECT doc_id, idx, nullif(regexp_extract(piece, '{_Y}', 1), '') AS year, list_sort(list_distinct({_sur('piece')})) AS surnames FROM nb
 UNION ALL SELECT doc_id, idx, regexp_extract(match, '((?:18|19|20)[0-9]{{2}})[a-z]?\\s*\\)$', 1), {_sur("regexp_extract(match, '^[^ ]+')")} FROM fo WHERE kind = 'narrative'), na AS (SELECT DISTINCT * FROM nx WHERE year IS NOT NULL AND len(surnames) > 0),
"""
_NOTED = f"""no AS (SELECT CAST(doc AS VARCHAR) AS doc_id, note_id, arg_max(text, CASE kind WHEN 'endnote' THEN 1 ELSE 0 END) AS text FROM ({_duck(_NOTES)}) GROUP BY ALL),
nd AS (SELECT DISTINCT b.doc_id, b.idx, nullif(regexp_extract(no.text, '{_Y}', 1), '') AS year, list_sort(list_distinct({_sur('left(no.text, 160)')})) AS surnames FROM b JOIN no ON no.doc_id = b.doc_id AND no.note_id = b.note), nt AS (SELECT * FROM nd WHERE year IS NOT NULL AND len(surnames) > 0),
"""
_HELD = f"""he AS (SELECT *, nullif(regexp_extract(text, '{_Y}', 1), '') AS year FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place, try_cast(regexp_extract(text, '^([0-9]+)[.] ', 1) AS INTEGER) AS stated, idx, regexp_replace(text, '^[0-9]+[.] ', '') AS text FROM p WHERE section = 'references')),
ha AS (SELECT *, list_transform({_sur("CASE WHEN year IS NOT NULL AND strpos(text, year) <= 160 THEN left(text, strpos(text, year) - 1) ELSE left(string_split(text, '. ')[1], 160) END")}, lambda s: lower(s)) AS a0, list_distinct({_sur('left(text, 180)')}) AS surnames FROM he),
hb AS (SELECT *, list_filter(a0, lambda x, i: list_position(a0, x) = i) AS a FROM ha),
ek AS (SELECT DISTINCT doc_id, place, unnest([s || y for s in list_filter([left(a[1], 3), a[1], list_aggregate([left(x, 1) for x in a[1:4]], 'string_agg', ''), list_aggregate([left(x, 1) for x in a[1:4]], 'string_agg', '') || '+', left(a[1], 3) || left(a[2], 3)], lambda s: s IS NOT NULL)] || [s || year for s in
 list_filter([left(a[1], 3), a[1], list_aggregate([left(x, 1) for x in a[1:4]], 'string_agg', ''), list_aggregate([left(x, 1) for x in a[1:4]], 'string_agg', '') || '+', left(a[1], 3) || left(a[2], 3)], lambda s: s IS NOT NULL)]) AS key FROM (SELECT *, right(year, 2) AS y FROM hb) WHERE year IS NOT NULL AND len(a) > 0),
"""
_ISSUE = "SELECT doc_id, 'references' AS \"check\", 'error' AS severity, code, CAST(idx AS INTEGER) AS para_index, CAST(detail AS VARCHAR) AS detail FROM"


def _unmatched(cited: str, code: str) -> str:
    met = f"(SELECT n.doc_id, n.idx, n.year, n.surnames, h.place FROM {cited} n JOIN hb h ON h.doc_id = n.doc_id AND h.year = n.year AND list_has_any(h.surnames, n.surnames))"
    return f"""SELECT n.doc_id, n.idx, '{code}_missing' AS code, concat_ws(' ', n.surnames[1], n.year) AS detail FROM {cited} n WHERE n.doc_id IN (SELECT doc_id FROM hb) AND (n.doc_id, n.idx, n.year, n.surnames) NOT IN (SELECT (doc_id, idx, year, surnames) FROM {met})
 UNION ALL SELECT doc_id, idx, '{code}_unused', place::VARCHAR FROM hb WHERE (doc_id, place) NOT IN (SELECT (doc_id, place) FROM {met})"""


_NUMBERS = r"""nr AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, '[\[(]\s*[0-9]{1,3}(?:\s*[,;–—-]\s*[0-9]{1,3})*\s*[\])]')) AS m FROM b UNION ALL SELECT doc_id, idx, substr(text, raised + 1, 4) FROM b WHERE raised IS NOT NULL),
np AS (SELECT doc_id, idx, unnest(regexp_extract_all(m, '[0-9]+(?:-[0-9]+)?')) AS piece FROM nr), nn AS (SELECT doc_id, CAST(unnest(range(CAST(string_split(piece, '-')[1] AS INTEGER), CAST(string_split(piece, '-')[-1] AS INTEGER) + 1)) AS INTEGER) AS number FROM np),
"""
QUERIES = {
    "ext14_located": (located, f"{P}{_matches()} z AS (SELECT 1) SELECT doc_id, kind, pos AS \"at\", idx, start, match FROM fo"),
    "ext12_entry_keys": (entry_keys, f"{P}{_HELD} z AS (SELECT 1) SELECT doc_id, CAST(place AS INTEGER) AS place, key FROM ek"),
    "ref06_keys": (
        key_issues,
        f"""{P}{_matches()}{_KEYS}{_HELD} fk AS (SELECT doc_id, lower(key) AS key, arg_min(idx, pos * 1000 + part) AS idx FROM ke WHERE doc_id IN (SELECT doc_id FROM hb) GROUP BY 1, 2)
            {_ISSUE} (SELECT doc_id, idx, 'key_missing' AS code, key AS detail FROM fk WHERE (doc_id, key) NOT IN (SELECT (doc_id, key) FROM ek)
            UNION ALL SELECT doc_id, idx, 'key_unused', place::VARCHAR FROM hb WHERE (doc_id, place) IN (SELECT (doc_id, place) FROM ek) AND (doc_id, place) NOT IN (SELECT (ek.doc_id, ek.place) FROM ek JOIN fk ON ek.doc_id = fk.doc_id AND ek.key = fk.key))""",
    ),
    "ref07_names": (name_issues, f"{P}{_matches()}{_NAMED}{_NOTED}{_HELD} z AS (SELECT 1) {_ISSUE} ({_unmatched('na', 'name')} UNION ALL {_unmatched('nt', 'note')})"),
    "ext21_styles": (
        styles,
        f"""{P}{_matches()}{_KEYS}{_NAMED}{_NOTED}{_HELD}{_NUMBERS} ct AS (SELECT doc_id, count(*) FILTER (k = 1) AS c1, count(*) FILTER (k = 2) AS c2, count(*) FILTER (k = 3) AS c3, count(*) FILTER (k = 4) AS c4 FROM
            (SELECT doc_id, 1 AS k FROM nn UNION ALL SELECT doc_id, 2 FROM na UNION ALL SELECT doc_id, 3 FROM ke UNION ALL SELECT doc_id, 4 FROM nt) GROUP BY doc_id), li AS (SELECT doc_id, count(*) AS n, greatest(count(*), coalesce(max(stated), 0)) AS most, bool_or(year IS NOT NULL) AS dated FROM hb GROUP BY doc_id),
            nu AS (SELECT doc_id, count(DISTINCT number) AS cited, count(DISTINCT number) FILTER (number > most) AS beyond FROM nn LEFT JOIN li USING (doc_id) GROUP BY doc_id),
            al AS (SELECT doc_id, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4, coalesce(n, 0) AS n, coalesce(dated, false) AS dated, coalesce(cited, 0) AS cited, coalesce(beyond, 0) AS beyond FROM ct FULL JOIN li USING (doc_id) LEFT JOIN nu USING (doc_id)),
            bs AS (SELECT *, greatest(c1, c2, c3, c4) AS best, c1 + c2 + c3 + c4 AS total FROM al)
            SELECT doc_id, CASE WHEN best = 0 OR (total - best > 2 AND best < 2 * greatest(1, total - best)) THEN 'unknown' WHEN c1 = best THEN CASE WHEN n > 0 AND cited >= 4 AND 2 * beyond > cited THEN 'unknown' ELSE 'numeric' END
              WHEN c2 = best THEN CASE WHEN dated THEN 'author_year' ELSE 'unknown' END WHEN c3 = best THEN CASE WHEN dated THEN 'key' ELSE 'unknown' END ELSE 'note' END AS style, total::BIGINT AS n_cited, n::BIGINT AS n FROM bs""",
    ),
}
