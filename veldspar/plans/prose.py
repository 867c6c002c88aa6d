"""Queries over legends, abbreviations, species and spelling: every document's lines, with phrases planted by position, and paragraphs after the last line."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import abbreviations as a
from veldspar.operators import legends as g
from veldspar.operators import species as s
from veldspar.operators import spelling as sp

from . import references as r

# Legends

_L_LINES = """SELECT doc, i, concat(line, CASE (doc + i) % 7 WHEN 0 THEN ' as in Fig. 2' WHEN 1 THEN ' (Figures 1-3)' WHEN 2 THEN ' see Table 4B, C here' WHEN 3 THEN ' and Supplementary Fig. S2a, b' ELSE '' END) AS text, 'results' AS section, false AS is_heading FROM lines"""
_L_ADDED = """SELECT doc, n + 10 * k + j AS i, CASE j WHEN 0 THEN concat(CASE (doc + k) % 6 WHEN 0 THEN concat('Figure ', CAST(k AS STRING), '. Title of it (A–C)') WHEN 1 THEN concat('Fig. ', CAST(k AS STRING), ' Title and') WHEN 2 THEN concat('Supplementary Table S', CAST(k AS STRING), ': Rows') WHEN 3 THEN concat('Figure ', CAST(k AS STRING), ', related to Figure 1. Title')
   WHEN 4 THEN concat('Figure ', CAST(k AS STRING), '. Adler et al. in J Water 1999;3') ELSE concat('Extended Data Figure ', CAST(k AS STRING), ' | (A, B) and (D)') END, '')
  WHEN 1 THEN CASE (doc + 2 * k) % 4 WHEN 0 THEN '(A) One, as in Fig. 9' WHEN 1 THEN 'plain text with Fig. 8' WHEN 2 THEN 'B) more. C. Three' ELSE 'Heading' END WHEN 2 THEN 'goes on with Figure 7 and (B)' WHEN 3 THEN CASE WHEN doc % 3 = 0 THEN '(C) and Fig. 6' ELSE '' END ELSE 'After it, see Figs. 1-3 and Table 2' END AS text,
 'figure_legends' AS section, j = 1 AND (doc + 2 * k) % 4 = 3 AS is_heading FROM ids, ks, (SELECT CAST(k - 1 AS INT) AS j FROM ks WHERE k <= 5) js WHERE k <= doc % 4"""
_LEGENDS = f"{_L_LINES} UNION ALL {_L_ADDED}"

# Abbreviations

_A_END = """CASE (doc + i) % 10 WHEN 0 THEN ' the complex microbial extract (CME) was' WHEN 1 THEN ' with CME and CMEs again' WHEN 2 THEN ' by the rate of change (ROC) and polymerase chain reaction (PCR)' WHEN 3 THEN ' (Analysis of similarities; ANOSIM) with' WHEN 4 THEN ' of 6-methylpteridine-2,4-diamine (6-MPDA)'
 WHEN 5 THEN ' germ-free (GF, n = 6) and MPDA or 5-MPDA' WHEN 6 THEN CASE WHEN doc % 4 = 1 THEN ' QZX, QZX and (QZX, Germany) or VWZ' ELSE ' QZX and QZX, VWZ' END WHEN 7 THEN ' the Institute of Water Studies (IWS) has' WHEN 8 THEN ' complex mineral extracts (CME) and "QRS" or a store (VWZ, Water Town)' ELSE '' END"""
_ABBREVIATED = f"SELECT doc, i, concat(line, {_A_END}) AS text, CASE WHEN i = 0 THEN 'abstract' WHEN i % 4 = 1 THEN 'methods' WHEN i % 4 = 2 THEN 'results' WHEN i % 4 = 3 THEN 'discussion' ELSE 'elsewhere' END AS section, false AS is_heading FROM lines"

# Species

_GENUS = "CASE doc % 4 WHEN 0 THEN 'Escherichia' WHEN 1 THEN 'Bacillus' WHEN 2 THEN 'Lactobacillus' ELSE 'Homo' END"
_EPITHET = "CASE doc % 4 WHEN 0 THEN 'coli' WHEN 1 THEN 'subtilis' WHEN 2 THEN 'casei' ELSE 'sapiens' END"
_S_START = f"CASE WHEN i = 0 AND doc % 5 > 0 THEN concat({_GENUS}, ' ', {_EPITHET}, ' and ') WHEN i = 1 AND doc % 6 = 1 THEN concat(lower({_GENUS}), ' ', {_EPITHET}, ' opens. ') ELSE '' END"
_S_END = f"""CASE (doc + i) % 8 WHEN 0 THEN concat(' of ', left({_GENUS}, 1), '. ', {_EPITHET}, ' there') WHEN 1 THEN concat(' by ', {_GENUS}, ' ', {_EPITHET}, ',') WHEN 2 THEN ' Lactobacillus spp. and Bacillus sp. too' WHEN 3 THEN CASE WHEN doc % 3 = 0 THEN concat(' from ', lower({_GENUS}), ' ', {_EPITHET}) ELSE '' END
 WHEN 4 THEN ' Taken diversity' WHEN 5 THEN CASE WHEN doc % 7 = 0 THEN ' Bacillus spp. again' ELSE '' END ELSE '' END"""
_SPECIES = f"SELECT doc, i, concat({_S_START}, line, {_S_END}) AS text, CASE WHEN i % 9 = 8 THEN 'references' ELSE 'results' END AS section, CASE WHEN i = 0 AND doc % 5 IN (1, 2) THEN length(concat({_GENUS}, ' ', {_EPITHET})) END AS italic FROM lines"

# Spelling

_SPELLED = """SELECT doc, i, concat(CASE WHEN (doc + i) % 6 = 1 THEN 'Grey ' ELSE '' END, line, CASE (doc + i) % 6 WHEN 0 THEN ' the colour of behaviour' WHEN 1 THEN CASE WHEN doc % 2 = 0 THEN ' color, analyzed colors' ELSE ' labelled at the Center of Gray' END WHEN 2 THEN ' a centre: Fiber modelling' WHEN 3 THEN CASE WHEN doc % 3 = 0 THEN ' hemoglobin and randomized fetal tumors' ELSE ' COLOURS' END ELSE '' END) AS text,
 CASE WHEN doc % 7 = 0 OR i % 5 = 4 THEN 'front_matter' WHEN i % 11 = 10 THEN 'references' ELSE 'results' END AS section FROM lines"""


def _rows(spark, sf_dir, sql, more=""):
    return spark.sql(f"WITH {r._TABLES} SELECT CAST(doc AS STRING) AS doc_id, CAST(i AS INT) AS idx, text, section{more} FROM ({sql})", docs=r._docs(spark, sf_dir))


def legend_rows(spark, sf_dir):
    return _rows(spark, sf_dir, _LEGENDS, ", is_heading")


def legends(spark, sf_dir):
    return g.legends(g.runs(legend_rows(spark, sf_dir))).select("doc_id", "idx", "kind", "grp", "number", "anchor", "n_absorbed", F.array_join("panels", "").alias("panels"))


def callouts(spark, sf_dir):
    return g.callouts(g.runs(legend_rows(spark, sf_dir))).select("doc_id", "idx", "kind", "grp", "number", F.array_join("panels", "").alias("panels"), "short")


def figure_issues(spark, sf_dir):
    return g.issues(g.runs(legend_rows(spark, sf_dir)))


def _abbreviated(spark, sf_dir):
    return _rows(spark, sf_dir, _ABBREVIATED, ", is_heading")


def definitions(spark, sf_dir):
    return a.definitions(a.read(_abbreviated(spark, sf_dir))).select("doc_id", "idx", "zone", "abbr", "start", "expansion")


def abbreviation_issues(spark, sf_dir):
    p = _abbreviated(spark, sf_dir)
    return a.issues(a.terms(p, a.read(p)))


def species_issues(spark, sf_dir):
    p = _rows(spark, sf_dir, _SPECIES, ", false AS is_heading, CASE WHEN italic IS NULL THEN array() ELSE array(named_struct('start', 0, 'end', italic)) END AS italic_spans")
    return s.issues(p, s.read(p))


def spelling_issues(spark, sf_dir):
    return sp.issues(sp.found(_rows(spark, sf_dir, _SPELLED, ", false AS is_heading")))


_IDS = r.P[: r.P.index("p AS (")]
_q, _W = r._q, r._W


def _p(sql: str, more: str = "") -> str:
    return f"{_IDS} p AS (SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS idx, text, section{more} FROM ({r._duck(sql)})),\n"


_LEGEND_RX, _CALL_RX = g.LEGEND, r"(?i)(?:^|[^A-Za-z0-9_])(?:((?:Supp(?:l(?:ement(?:ary|al)?)?)?\.?|Extended\s+Data|Online\s+Resource)\s*)?(Fig(?:ure)?s?\.?|Tables?)\s*(S?[0-9]+[A-Za-z]?(?:-[0-9]+|(?:, [A-Za-z])+)?))"
_RUNS = f"""{_p(_LEGENDS, ', is_heading')} rl AS (SELECT *, regexp_matches(text, '{_q(_LEGEND_RX)}') AS looks, regexp_matches(left(text, 220), '(?i)(?:^|[^A-Za-z0-9_])et al(?:$|[^A-Za-z0-9_])') AND NOT (contains(left(text, 220), '(A)') OR contains(left(text, 220), '(a)') OR length(text) > 400) AS entry FROM p),
rm AS (SELECT *, looks AND NOT entry AND NOT is_heading AS legend, is_heading OR trim(text) = '' OR looks AS opens FROM rl), rn AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM rm),
ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY idx) AS at_run FROM rn), rp AS (SELECT doc_id, run FROM ro GROUP BY doc_id, run HAVING bool_or(at_run = 1 AND legend) AND bool_or(at_run = 2 AND regexp_matches(text, '^\\s*\\(?[A-Za-z]\\)'))),
rt AS (SELECT ro.*, rp.run IS NOT NULL AND NOT opens AS absorbed FROM ro LEFT JOIN rp ON rp.doc_id = ro.doc_id AND rp.run = ro.run),
"""
_LETTERS = "list_transform(range(ascii({0}), ascii({1}) + 1), lambda n: chr(n::INTEGER))"
_PANELS = f"""list_concat(flatten(list_transform(regexp_extract_all(full_text, '\\(([A-Za-z][–-][A-Za-z])\\)', 1), lambda x: {_LETTERS.format('upper(x[1])', 'upper(x[-1])')})), list_concat(flatten(list_transform(regexp_extract_all(full_text, '\\(([A-Za-z](?:, ?[A-Za-z])*)\\)', 1), lambda x: regexp_extract_all(upper(x), '[A-Z]'))), regexp_extract_all(full_text, '(?:^|[.;:]\\s+)([A-Z])[.)]\\s', 1)))"""
_GROUP = "CASE WHEN contains(lower({0}), 'extended') THEN 'extended' WHEN {0} <> '' OR upper({1})[1] = 'S' THEN 'supplementary' ELSE 'main' END"
_LEG = f"""lc AS (SELECT doc_id, run, min(idx) AS idx, arg_min(text, idx) AS head, trim(string_agg(text, ' ' ORDER BY idx)) AS full_text, count(*) - 1 AS n_absorbed FROM rt WHERE legend OR absorbed GROUP BY doc_id, run),
ld AS (SELECT doc_id, idx, head, full_text, n_absorbed, regexp_extract(head, '{_q(_LEGEND_RX)}', 1) AS pre, lower(regexp_extract(head, '{_q(_LEGEND_RX)}', 2)) AS word, regexp_extract(head, '{_q(_LEGEND_RX)}', 3) AS label, trim(regexp_extract(head, '{_q(_LEGEND_RX)}')) AS anchor, {_PANELS} AS f FROM lc)
"""

#: The long form and the bracket as one pattern.
_AFTER = rf"(({a._TERM}{{0,6}})\s*[(\[]{a._NUMBER})({a._SHORT})s?(\s*[,;]\s*[^)\]]{{0,45}})?[)\]]"
_A_WORD = r"(?:^|[^\p{L}\p{N}_])((?:[0-9]{1,2}[-‐–])?[a-z]?[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9-]{0,8})"
_NEVER = "(" + ", ".join(f"'{x}'" for x in a.NEVER) + ")"
_SMALL = "(" + ", ".join(f"'{x}'" for x in a.SMALL) + ")"
_NORMAL = "CASE WHEN regexp_full_match({0}, '[^a-z]*[A-Z][^a-z]*s') THEN regexp_replace({0}, 's+$', '') ELSE {0} END"


def _defined(rx: str, extra: bool) -> str:
    groups = ", ".join(f"regexp_extract_all(text, '{_q(rx)}', {k}) AS g{k}" for k in (0, 1, 2, 3)) + (f", regexp_extract_all(text, '{_q(rx)}', 4) AS g4" if extra else ", list_transform(regexp_extract_all(text, '" + _q(rx) + "'), lambda x: '') AS g4")
    return f"SELECT doc_id, idx, zone, text, list_transform(string_split_regex(text, '{_q(rx)}'), lambda x: length(x)) AS gaps, {groups} FROM z"


_DERIVED = "[list_aggregate(w, 'string_agg', ' ') for w in [ws[-n:] for n in [ln, ln + 1, ln + 2, ln + 3] if n <= len(ws) and n > 0] if [lower(x[1]) for x in w if lower(x) NOT IN {small}] = ls]"
_DEFS = f"""{_p(_ABBREVIATED)} z AS (SELECT *, CASE WHEN section IN ('abstract', 'methods') THEN section WHEN section IN ('introduction', 'results', 'discussion', 'conclusions') THEN 'main' END AS zone FROM p WHERE zone IS NOT NULL),
da AS ({_defined(_AFTER, True)} UNION ALL {_defined(a.INSIDE, False)}), db AS (SELECT *, unnest(range(1, len(g0) + 1)) AS k FROM da),
dc AS (SELECT doc_id, idx, zone, text, CAST(list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(g0[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, g1[k] AS front, trim(g2[k]) AS term, g3[k] AS short, coalesce(g4[k], '') <> '' AS extra FROM db),
dd AS (SELECT doc_id, idx, zone, text, pos + length(front) AS start, pos + length(front) + length(short) AS stop, term, extra, {_NORMAL.format('short')} AS abbr, substr(text, CAST(greatest(pos - 90, 0) AS BIGINT) + 1, CAST(pos + length(front) - greatest(pos - 90, 0) AS BIGINT)) AS lead FROM dc),
de AS (SELECT *, regexp_extract_all(lower(abbr), '[a-z]') AS ls, len(regexp_extract_all(lower(abbr), '[a-z]')) AS ln, list_filter(regexp_split_to_array(term, '\\s+'), lambda x: x <> '') AS w1, list_filter(regexp_split_to_array(term, '[\\s‐-]+'), lambda x: x <> '') AS w2 FROM dd),
df AS (SELECT *, ({_DERIVED.format(small=_SMALL).replace('ws', 'w1')} || {_DERIVED.format(small=_SMALL).replace('ws', 'w2')})[1] AS expansion,
  regexp_matches(lower(right(CASE WHEN lead <> '' THEN lead ELSE term END, CAST(8 * ln + 10 AS BIGINT))), '(?s)' || list_aggregate(ls, 'string_agg', '.*')) AS inside FROM de),
dg AS (SELECT * FROM df WHERE length(abbr) >= 2 AND upper(abbr) NOT IN {_NEVER} AND upper(w1[-1]) NOT IN {_NEVER} AND (len(w1) >= least(2, length(regexp_replace(abbr, '[^A-Z]', '', 'g'))) OR lower(term[1]) = lower(abbr[1]) OR inside) AND (NOT extra OR expansion IS NOT NULL)),
"""
_STANDARD = "(" + ", ".join(f"'{x}'" for x in sorted(set(a.STANDARD))) + ")"
#: Uses word by word: a token of letters, digits and hyphens with what stands on its sides.
_USES = f"""ua AS (SELECT doc_id, idx, zone, text, list_transform(string_split_regex(text, '{_q(a.USE[a.USE.index('(?:[0-9]'):a.USE.rindex('(?!')])}'), lambda x: length(x)) AS gaps, regexp_extract_all(text, '{_q(a.USE[a.USE.index('(?:[0-9]'):a.USE.rindex('(?!')])}') AS found FROM z), ub AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM ua),
uc AS (SELECT doc_id, idx, zone, text, found[k] AS said, CAST(list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM ub),
ud AS (SELECT *, start + length(said) AS stop, substr(text, start, 1) AS before, substr(text, start + length(said) + 1, 1) AS after, regexp_replace(said, '^[0-9]{{1,2}}[-‐–]', '') AS bare FROM uc),
ue AS (SELECT doc_id, idx, zone, start, {_NORMAL.format('bare')} AS abbr FROM ud WHERE (start = 0 OR NOT regexp_matches(before, '[\\p{{L}}\\p{{N}}_]')) AND NOT regexp_matches(after, '[\\p{{L}}\\p{{N}}_]') AND NOT (start > 0 AND after <> '' AND contains('''‘“"', before) AND contains('''’”"', after))
  AND NOT EXISTS (SELECT 1 FROM dg WHERE dg.doc_id = ud.doc_id AND dg.idx = ud.idx AND ud.start < dg.stop AND ud.stop > dg.start)), uf AS (SELECT * FROM ue WHERE length(abbr) >= 2 AND upper(abbr) NOT IN {_NEVER}),
ve AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[(,]\\s*([A-Z]{{3,8}})\\s*,\\s*[^)]{{2,45}}\\)', 1)) AS abbr FROM p),
tl AS (SELECT * FROM dg WHERE upper(abbr) NOT IN {_STANDARD} AND (doc_id, abbr) NOT IN (SELECT (doc_id, abbr) FROM dg WHERE regexp_matches(concat_ws(' ', lead, term), '{_q(a.ORGANISATION.replace('(?<![' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])', '(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])'))}'))),
f1 AS (SELECT doc_id, abbr, min(idx * 100000 + start) AS made, max(idx) AS last FROM tl GROUP BY 1, 2), e1 AS (SELECT doc_id, abbr, min(idx * 100000 + start) AS at_, min(idx) AS idx, count(*) AS n FROM uf GROUP BY 1, 2),
lo AS (SELECT * FROM e1 WHERE n >= 3 AND regexp_full_match(abbr, '[A-Z]{{3,8}}') AND abbr NOT IN {_STANDARD} AND (doc_id, abbr) NOT IN (SELECT (doc_id, abbr) FROM dg) AND (doc_id, abbr) NOT IN (SELECT (doc_id, abbr) FROM ve)),
di AS (SELECT doc_id, abbr, regexp_replace(lower(expansion), 's+$', '') AS key, arg_min(expansion, idx * 100000 + start) AS e FROM tl WHERE expansion IS NOT NULL GROUP BY 1, 2, 3)
"""

_SECTIONS = "(" + ", ".join(f"'{x}'" for x in s.SECTIONS) + ")"
_NG, _NE = "(" + ", ".join(f"'{x}'" for x in s.NO_GENUS) + ")", "(" + ", ".join(f"'{x}'" for x in s.NO_EPITHET) + ")"
#: Names word by word: a token that ends in a genus or an initial before one that begins with an epithet.
_NAMES = f"""{_p(_SPECIES, ', italic')} b AS (SELECT *, regexp_split_to_array(text, '\\s+') AS t FROM p WHERE section IN {_SECTIONS} AND text <> ''), w AS (SELECT doc_id, idx, italic, text, t, unnest(range(1, len(t) + 1)) AS k FROM b), pr AS (SELECT doc_id, idx, italic, k, t[k] AS x, coalesce(t[k + 1], '') AS y FROM w),
pa AS (SELECT *, regexp_extract(x, '(?:^|[^\\p{{L}}\\p{{N}}_.])([A-Z][a-z]{{3,}})$', 1) AS genus, regexp_extract(x, '(?:^|[^\\p{{L}}\\p{{N}}_.])([A-Z])\\.$', 1) AS initial, CASE WHEN regexp_full_match(y, '[a-z]{{3,}}(?:[^\\p{{L}}\\p{{N}}_-].*)?') THEN regexp_extract(y, '^[a-z]+') ELSE '' END AS epithet, regexp_extract(y, '^spp?\\.') AS form FROM pr),
fu AS (SELECT doc_id, idx, k, genus, epithet, italic IS NOT NULL AND k = 1 AND idx = 0 AS italic FROM pa WHERE genus <> '' AND epithet <> '' AND genus NOT IN {_NG} AND epithet NOT IN {_NE} AND NOT regexp_matches(genus, '{s.HIGHER}')),
fi AS (SELECT doc_id, left(genus, 1) AS initial, arg_min(genus, idx * 1000000 + k) AS genus FROM fu GROUP BY 1, 2), br AS (SELECT pa.doc_id, idx, k, fi.genus, epithet FROM pa JOIN fi ON fi.doc_id = pa.doc_id AND fi.initial = pa.initial WHERE epithet <> ''),
un AS (SELECT doc_id, idx, k, genus, form FROM pa WHERE genus <> '' AND form <> ''),
ev AS (SELECT DISTINCT doc_id, genus, epithet FROM fu WHERE italic OR (doc_id, genus, epithet) IN (SELECT (doc_id, genus, epithet) FROM br) OR (doc_id, genus) IN (SELECT (doc_id, genus) FROM un)),
me AS (SELECT fu.*, false AS brief FROM fu SEMI JOIN ev USING (doc_id, genus, epithet) UNION ALL SELECT br.doc_id, br.idx, br.k, br.genus, br.epithet, false, true FROM br SEMI JOIN ev USING (doc_id, genus, epithet)),
mr AS (SELECT *, row_number() OVER o AS rk, sum((NOT brief)::INTEGER) OVER o AS f FROM me WINDOW o AS (PARTITION BY doc_id, genus, epithet ORDER BY idx, k)),
pe AS (SELECT doc_id, genus, epithet, genus || ' ' || epithet AS name, count(*) AS n, count(*) FILTER (italic) AS ni, min(idx) FILTER (NOT italic) AS plain, bool_or(rk = 1 AND brief) AS first_brief, min(idx) AS idx, count(*) FILTER (NOT brief) AS nf, min(idx) FILTER (NOT brief AND f = 2) AS again FROM mr GROUP BY 1, 2, 3),
lw AS (SELECT b.doc_id, b.idx, pe.name, regexp_extract(b.text, '^(.*?)(?:^|[^\\p{{L}}\\p{{N}}_.])' || lower(pe.genus) || '\\s+' || pe.epithet || '(?:$|[^\\p{{L}}\\p{{N}}_-])', 0) AS m, regexp_extract(b.text, '^(.*?)' || '(?:^|[^\\p{{L}}\\p{{N}}_.])' || lower(pe.genus) || '\\s+' || pe.epithet || '(?:$|[^\\p{{L}}\\p{{N}}_-])', 1) AS before FROM b JOIN pe ON pe.doc_id = b.doc_id WHERE contains(b.text, lower(pe.genus) || ' ' || pe.epithet))
"""
_SPELL = f"""{_p(_SPELLED)} kw AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{f}', {str(b).lower()})" for w, f, b in sp.table())}) t(word, family, british)), bo AS (SELECT * FROM p WHERE text <> '' AND section <> 'references' QUALIFY section <> 'front_matter' OR NOT bool_or(section <> 'front_matter') OVER (PARTITION BY doc_id)),
tk AS (SELECT doc_id, idx, string_split_regex(text, '[A-Za-zÀ-ɏ0-9_]+') AS gaps, regexp_extract_all(text, '[A-Za-zÀ-ɏ0-9_]+') AS ws FROM bo), tu AS (SELECT doc_id, idx, unnest(range(1, len(ws) + 1)) AS k, ws, gaps FROM tk),
hi AS (SELECT doc_id, idx, k, word, family, british FROM (SELECT doc_id, idx, k, ws[k] AS said, rtrim(gaps[k]) AS gap FROM tu) u JOIN kw ON kw.word = lower(said) WHERE NOT (regexp_matches(said, '^[A-Z]') AND (k > 1 OR gap <> '') AND NOT regexp_matches(gap, '[.!?:]$'))),
wh AS (SELECT doc_id, count(*) FILTER (british) AS b, count(*) FILTER (NOT british) AS a FROM hi GROUP BY 1 HAVING a > 0 AND b > 0), pw AS (SELECT doc_id, family, british, word, count(*) AS n, min(idx * 1000000 + k) AS first, min(idx) AS idx FROM hi GROUP BY 1, 2, 3, 4),
od AS (SELECT doc_id, family, british, sum(n) AS times, min(idx) AS idx, arg_min(word, -n * 1000000000000 + first) AS word FROM pw JOIN wh USING (doc_id) WHERE british = (b < a) GROUP BY 1, 2, 3)
"""


_LEGEND_ROWS = f"""SELECT doc_id, idx, CASE WHEN starts_with(word, 'fig') THEN 'figure' ELSE 'table' END AS kind, {_GROUP.format('pre', 'label')} AS grp, CAST(regexp_replace(label, '[^0-9]', '', 'g') AS INTEGER) AS number, anchor, n_absorbed::INTEGER AS n_absorbed,
 CASE WHEN starts_with(word, 'fig') THEN coalesce(list_aggregate(list_filter({_LETTERS.format("'A'", "'Z'")}, lambda c: len(list_filter({_LETTERS.format("'A'", "c")}, lambda x: NOT list_contains(f, x))) = 0), 'string_agg', ''), '') ELSE '' END AS panels FROM ld"""
_CALLOUTS = f"""cz AS (SELECT doc_id, idx, unnest(range(len(regexp_extract_all(text, '{_q(_CALL_RX)}')))) AS k, unnest(regexp_extract_all(text, '{_q(_CALL_RX)}', 1)) AS pre, unnest(regexp_extract_all(text, '{_q(_CALL_RX)}', 2)) AS word, unnest(regexp_extract_all(text, '{_q(_CALL_RX)}', 3)) AS spec FROM rt WHERE NOT legend AND NOT absorbed AND NOT is_heading AND section <> 'references'),
cy AS (SELECT *, CAST(regexp_extract(spec, '([0-9]+)', 1) AS INTEGER) AS lo, CAST(coalesce(nullif(regexp_extract(spec, '-([0-9]+)', 1), ''), regexp_extract(spec, '([0-9]+)', 1)) AS INTEGER) AS hi, regexp_replace(spec, '^S', '') AS rest FROM cz)"""
_CALLOUT_ROWS = f"""SELECT doc_id, idx, k, CASE WHEN starts_with(lower(word), 'fig') THEN 'figure' ELSE 'table' END AS kind, {_GROUP.format('pre', 'spec')} AS grp, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS number, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(upper(rest), '[A-Z]'))), 'string_agg', ''), '') AS panels, starts_with(lower(word), 'fig') AND NOT starts_with(lower(word), 'figure') AS short FROM cy"""
_FIGURES = f"""{_RUNS}{_LEG}, {_CALLOUTS}, lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, grp, number ORDER BY idx) AS n FROM ({_LEGEND_ROWS})), l1 AS (SELECT * FROM lr WHERE n = 1), cr AS ({_CALLOUT_ROWS}), fc AS (SELECT doc_id, kind, grp, number, min(idx * 1000000 + k * 1000 + number) AS place, min(idx) AS idx FROM cr GROUP BY ALL),
gl AS (SELECT DISTINCT doc_id, kind, grp FROM l1), nu AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, kind, grp ORDER BY number) AS before FROM l1), up AS (SELECT DISTINCT doc_id, idx, kind, grp, number, unnest(string_split(panels, '')) AS panel FROM cr WHERE panels <> ''),
us AS (SELECT doc_id, kind, grp, number, list(DISTINCT panel) AS used FROM up GROUP BY ALL)
"""


def _issue(check: str, rows: str) -> str:
    return f"SELECT doc_id, '{check}' AS \"check\", severity, code, CAST(idx AS INTEGER) AS para_index, CAST(detail AS VARCHAR) AS detail FROM ({rows})"


QUERIES = {
    "ext05_legends": (legends, f"{_RUNS}{_LEG} {_LEGEND_ROWS}"),
    "ext05_callouts": (callouts, f"{_RUNS}{_CALLOUTS} SELECT * EXCLUDE (k) FROM ({_CALLOUT_ROWS})"),
    "fig11_figures": (
        figure_issues,
        _FIGURES + _issue(
            "figures",
            """SELECT DISTINCT * FROM (SELECT doc_id, 'warning' AS severity, 'duplicate_legend' AS code, idx, concat_ws(' ', kind, grp, number) AS detail FROM lr WHERE n > 1
            UNION ALL SELECT doc_id, 'error', 'no_legend', idx, concat_ws(' ', kind, grp, number) FROM fc SEMI JOIN gl USING (doc_id, kind, grp) ANTI JOIN l1 USING (doc_id, kind, grp, number)
            UNION ALL SELECT doc_id, 'info', 'no_legends_at_all', NULL, concat_ws(' ', kind, count(*)) FROM fc ANTI JOIN gl USING (doc_id, kind, grp) WHERE grp = 'main' GROUP BY doc_id, kind
            UNION ALL SELECT doc_id, 'error', 'never_cited', idx, concat_ws(' ', kind, grp, number) FROM l1 ANTI JOIN fc USING (doc_id, kind, grp, number)
            UNION ALL SELECT doc_id, 'warning', 'numbering', idx, CASE WHEN before IS NULL THEN concat_ws(' ', kind, grp, 'start', number) ELSE concat_ws(' ', kind, grp, before, number) END FROM nu WHERE (before IS NULL AND number <> 1) OR number - before > 1
            UNION ALL SELECT a.doc_id, 'warning', 'citation_order', a.idx, concat_ws(' ', a.kind, a.grp, a.number, 'before', min(z.number)) FROM fc a JOIN fc z ON a.doc_id = z.doc_id AND a.kind = z.kind AND a.grp = z.grp AND z.number < a.number AND z.place > a.place GROUP BY a.doc_id, a.idx, a.kind, a.grp, a.number
            UNION ALL SELECT up.doc_id, 'warning', 'unknown_panel', up.idx, concat_ws(' ', kind, grp, number) || panel FROM up JOIN l1 USING (doc_id, kind, grp, number) WHERE l1.panels <> '' AND NOT contains(l1.panels, panel)
            UNION ALL SELECT doc_id, 'info', 'panels_not_cited', l1.idx, concat_ws(' ', kind, grp, number) || ' ' || list_aggregate(list_filter(string_split(panels, ''), lambda x: NOT list_contains(used, x)), 'string_agg', ',') FROM l1 JOIN us USING (doc_id, kind, grp, number) WHERE len(list_filter(string_split(panels, ''), lambda x: NOT list_contains(used, x))) > 0 AND panels <> ''
            UNION ALL SELECT doc_id, 'info', 'mixed_names', NULL, count(*) FILTER (short) || '/' || count(*) FROM cr WHERE kind = 'figure' GROUP BY doc_id HAVING bool_or(short) AND NOT bool_and(short))""",
        ),
    ),
    "ext23_definitions": (definitions, f"{_DEFS} y AS (SELECT 1) SELECT doc_id, idx, zone, abbr, start::INTEGER AS start, expansion FROM dg"),
    "abb05_abbreviations": (
        abbreviation_issues,
        _DEFS + _USES + _issue(
            "abbreviations",
            """SELECT e1.doc_id, 'warning' AS severity, 'used_before_defined' AS code, e1.idx, e1.abbr AS detail FROM e1 JOIN f1 ON e1.doc_id = f1.doc_id AND e1.abbr = f1.abbr WHERE at_ < made
            UNION ALL SELECT doc_id, 'warning', 'defined_twice', list_sort(list(idx))[2], abbr || ' ' || zone || ' ' || count(*) FROM tl WHERE expansion IS NOT NULL GROUP BY doc_id, abbr, zone HAVING count(*) > 1
            UNION ALL SELECT di.doc_id, 'warning', 'differing_expansions', any_value(last), di.abbr || ': ' || string_agg(e, '; ' ORDER BY e) FROM di JOIN f1 ON di.doc_id = f1.doc_id AND di.abbr = f1.abbr GROUP BY di.doc_id, di.abbr HAVING count(*) > 1
            UNION ALL SELECT doc_id, 'info', 'never_used', min(idx), abbr FROM tl WHERE expansion IS NOT NULL AND zone <> 'methods' AND (doc_id, abbr) NOT IN (SELECT (doc_id, abbr) FROM e1) GROUP BY doc_id, abbr
            UNION ALL SELECT doc_id, 'info', 'never_defined', arg_min(idx, abbr), list_aggregate(list(abbr || ' ' || n ORDER BY abbr)[1:8], 'string_agg', ', ') FROM lo GROUP BY doc_id""",
        ),
    ),
    "spc01_species": (
        species_issues,
        _NAMES + _issue(
            "species",
            f"""SELECT doc_id, 'warning' AS severity, 'mixed_italics' AS code, plain AS idx, name || ' ' || ni || ' ' || (n - ni) AS detail FROM pe WHERE n >= 2 AND ni > 0 AND plain IS NOT NULL UNION ALL SELECT doc_id, 'warning', 'never_italic', plain, name FROM pe WHERE n >= 2 AND ni = 0
            UNION ALL SELECT doc_id, 'warning', 'short_before_full', idx, name FROM pe WHERE first_brief UNION ALL SELECT doc_id, 'info', 'full_again', again, name || ' ' || (nf - 1) FROM pe WHERE NOT first_brief AND nf > 1 AND nf < n
            UNION ALL SELECT doc_id, 'info', 'sp_and_spp', min(idx), genus FROM un WHERE genus NOT IN {_NG} GROUP BY doc_id, genus HAVING count(DISTINCT form) > 1
            UNION ALL SELECT doc_id, 'warning', 'lower_case_genus', min(idx), name FROM lw WHERE m <> '' AND NOT regexp_matches(rtrim(before || substr(m, length(before) + 1, CASE WHEN length(before) + 1 = 1 AND regexp_matches(m, '^[a-z]') THEN 0 ELSE 1 END)), '[.!?]$') GROUP BY doc_id, name""",
        ),
    ),
    "con04_families": (spelling_issues, _SPELL + _issue("consistency", "SELECT doc_id, 'warning' AS severity, 'spelling' AS code, idx, concat_ws(' ', word, CASE WHEN british THEN 'British' ELSE 'American' END, times::VARCHAR) AS detail FROM od")),
}
