"""Queries over funding calls: a short fixed list of invented calls, and customers as researchers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from veldspar.operators import funding
from veldspar.sources import schemas

TODAY = date(2026, 10, 1)
D = date.fromisoformat
_LIST = [
    dict(id="alpha", name="Alpha Fund", category="postdoc", fields=["biology"], phd_required=True, max_years=8.0, breaks_extend=True, deadlines=[("final", D("2027-01-15"), False), ("internal", D("2026-12-01"), False)], annual=True, host_letter=True, verified=D("2026-09-01")),
    dict(id="beta", name="beta grants", category="postdoc", fields=["any"], phd_required=True, min_years=2.0, max_years=12.0, breaks_extend=False, nationalities=["AA", "BB", "CC"], deadlines=[("final", D("2026-11-20"), False)], verified=D("2026-01-10")),
    dict(id="gamma", name="Gamma Travel", category="travel", deadlines=[("final", D("2026-10-20"), True)], hosts=["AA", "DD"], excluded_hosts=["DD"], verified=D("2025-01-01")),
    dict(id="delta", name="Delta", category="phd", levels=["student"], deadlines=[], rolling=True, residence=["AA", "EE"]),
    dict(id="epsilon", name="Epsilon", category="postdoc", phd_required=True, host_anywhere=True, max_months=12, window_years=3, deadlines=[("final", D("2027-03-01"), False)], verified=D("2026-05-05"), membership="Society"),
    dict(id="zeta", name="Zeta", category="postdoc", excluded_nationalities=["BB"], clinical_only=True, deadlines=[("final", D("2026-02-01"), False)], annual=True, custom=True, other_rules=["ask first"]),
]


def calls(spark):
    from pyspark.sql.types import StructType, _parse_datatype_string

    shape: StructType = _parse_datatype_string(schemas.CALL)
    return spark.createDataFrame([tuple(c.get(f.name) for f in shape) for c in _LIST], shape)


def _literal(v, kind):
    if v is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(v, list) and "STRUCT" in kind:
        return "CAST([" + ", ".join(f"{{'kind': '{k}', 'date': DATE '{d}', 'estimated': {str(e).lower()}}}" for k, d, e in v) + f"] AS {kind})"
    if isinstance(v, list):
        return f"CAST([{', '.join(repr(x) for x in v)}] AS {kind})"
    return f"DATE '{v}'" if isinstance(v, date) else str(v).lower() if isinstance(v, bool) else repr(v)


_KINDS = dict(
    id="VARCHAR", name="VARCHAR", category="VARCHAR", fields="VARCHAR[]", clinical_only="BOOLEAN", phd_required="BOOLEAN", min_years="DOUBLE", max_years="DOUBLE", breaks_extend="BOOLEAN", nationalities="VARCHAR[]", excluded_nationalities="VARCHAR[]", residence="VARCHAR[]",
    hosts="VARCHAR[]", host_anywhere="BOOLEAN", excluded_hosts="VARCHAR[]", max_months="INTEGER", window_years="INTEGER", deadlines='STRUCT(kind VARCHAR, "date" DATE, estimated BOOLEAN)[]', rolling="BOOLEAN", annual="BOOLEAN", levels="VARCHAR[]", membership="VARCHAR", other_rules="VARCHAR[]",
    host_letter="BOOLEAN", verified="DATE", custom="BOOLEAN",
)
CALLS_SQL = " UNION ALL ".join("SELECT " + ", ".join(f"{_literal(c.get(n), k)} AS {n}" for n, k in _KINDS.items()) for c in _LIST)
_NATION = lambda key: f"substr('AABBCCDDEE', ({key} % 5) * 2 + 1, 2)"


def people(spark, sf_dir):
    """Customers as researchers; keys decide what is known."""
    k = "CAST(c_custkey AS INT)"
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_name AS person", f"CASE WHEN {k} % 7 > 1 THEN date_sub(DATE '2026-06-01', {k} % 6000) END AS phd_date", f"CASE WHEN {k} % 7 = 1 THEN date_add(DATE '2026-12-01', {k} % 300) END AS phd_expected", f"CASE WHEN {k} % 4 = 0 THEN CAST({k} % 30 AS DOUBLE) END AS break_months",
        f"CASE WHEN {k} % 9 > 0 THEN array({_NATION('c_nationkey')}, {_NATION('c_nationkey + 2')}) END AS nationalities", f"CASE WHEN {k} % 5 > 0 THEN {_NATION('c_nationkey')} END AS residence",
        f"CASE WHEN {k} % 3 > 0 THEN array(named_struct('country', {_NATION('c_nationkey')}, 'start', date_sub(DATE '2026-06-01', {k} % 1500), 'end', CASE WHEN {k} % 2 = 0 THEN date_sub(DATE '2026-06-01', {k} % 700) END)) END AS stays",
        f"CASE WHEN {k} % 2 = 0 THEN array('biology') ELSE array('physics') END AS fields", f"CASE WHEN {k} % 6 > 1 THEN {k} % 6 = 2 END AS clinical", f"CASE WHEN {k} % 8 > 0 THEN array({_NATION('c_nationkey')}, {_NATION('c_nationkey + 3')}) END AS targets", f"CASE WHEN {k} % 4 > 0 THEN CASE WHEN {k} % 4 = 1 THEN 'student' ELSE 'postdoc' END END AS level",
    )


_k = "CAST(c_custkey AS INT)"
PEOPLE_SQL = f"""SELECT c_name AS person, CASE WHEN {_k} % 7 > 1 THEN DATE '2026-06-01' - {_k} % 6000 END AS phd_date, CASE WHEN {_k} % 7 = 1 THEN DATE '2026-12-01' + {_k} % 300 END AS phd_expected, CASE WHEN {_k} % 4 = 0 THEN CAST({_k} % 30 AS DOUBLE) END AS break_months,
    CASE WHEN {_k} % 9 > 0 THEN [{_NATION('c_nationkey')}, {_NATION('c_nationkey + 2')}] END AS own_nationalities, CASE WHEN {_k} % 5 > 0 THEN {_NATION('c_nationkey')} END AS own_residence,
    CASE WHEN {_k} % 3 > 0 THEN {_NATION('c_nationkey')} END AS stay, DATE '2026-06-01' - {_k} % 1500 AS stay_start, CASE WHEN {_k} % 2 = 0 THEN DATE '2026-06-01' - {_k} % 700 END AS stay_end,
    CASE WHEN {_k} % 2 = 0 THEN ['biology'] ELSE ['physics'] END AS own_fields, CASE WHEN {_k} % 6 > 1 THEN {_k} % 6 = 2 END AS clinical, CASE WHEN {_k} % 8 > 0 THEN [{_NATION('c_nationkey')}, {_NATION('c_nationkey + 3')}] END AS targets,
    CASE WHEN {_k} % 4 > 0 THEN CASE WHEN {_k} % 4 = 1 THEN 'student' ELSE 'postdoc' END END AS level FROM customer"""
_next = "list_min(list_transform(list_filter(deadlines, lambda d: d.kind = 'final' AND d.date >= DATE '2026-10-01'), lambda d: d.date))"
BOTH = f"""WITH calls AS ({CALLS_SQL}), c AS (SELECT *, {_next} AS deadline FROM calls), w AS (SELECT p.*, c.*, coalesce(deadline, DATE '2026-10-01') AS refday FROM ({PEOPLE_SQL}) p CROSS JOIN c),
x AS (SELECT *, date_diff('day', phd_date, refday) / 365.25::DOUBLE AS years, coalesce(break_months, 0) / 12 AS gap, list_filter(targets, lambda h: (hosts IS NULL OR list_contains(hosts, h)) AND NOT list_contains(coalesce(excluded_hosts, []), h)) AS open_targets,
      list_filter(own_nationalities, lambda n: NOT list_contains(coalesce(excluded_nationalities, []), n)) AS free FROM w),
y AS (SELECT *, CASE WHEN stay IS NULL THEN NULL ELSE greatest(0, date_diff('day', greatest(stay_start, CAST(refday - to_years(window_years) AS DATE)), least(coalesce(stay_end, refday), refday))) / 30.44::DOUBLE END AS away FROM x),
r AS (SELECT person, id, unnest(['career_stage', 'nationality', 'residence', 'host', 'mobility', 'clinical', 'level', 'membership', 'other_rules', 'verified', 'deadline']) AS rule, unnest([
  CASE WHEN NOT coalesce(phd_required, false) AND min_years IS NULL AND max_years IS NULL THEN NULL WHEN phd_date IS NULL AND phd_expected IS NULL THEN 'unsure'
       WHEN phd_date IS NULL THEN CASE WHEN date_diff('day', phd_expected, refday) / 365.25::DOUBLE < min_years THEN 'not_met' ELSE 'unsure' END WHEN years < 0 THEN 'unsure' WHEN years < min_years THEN 'not_met'
       WHEN years > max_years THEN CASE WHEN gap > 0 AND years - gap <= max_years THEN CASE WHEN breaks_extend THEN 'met' ELSE 'unsure' END ELSE 'not_met' END ELSE 'met' END,
  CASE WHEN nationalities IS NULL AND excluded_nationalities IS NULL THEN NULL WHEN own_nationalities IS NULL THEN 'unsure' WHEN len(free) = 0 THEN 'not_met' WHEN nationalities IS NULL OR list_has_any(free, nationalities) THEN 'met' ELSE 'not_met' END,
  CASE WHEN residence IS NULL THEN NULL WHEN own_residence IS NULL THEN 'unsure' WHEN list_contains(residence, own_residence) THEN 'met' ELSE 'not_met' END,
  CASE WHEN targets IS NULL THEN CASE WHEN hosts IS NOT NULL THEN 'unsure' END WHEN len(open_targets) = 0 THEN 'not_met' WHEN hosts IS NULL AND NOT coalesce(host_anywhere, false) THEN 'unsure' ELSE 'met' END,
  CASE WHEN max_months IS NULL THEN NULL WHEN stay IS NULL OR targets IS NULL THEN 'unsure' WHEN len(list_filter(open_targets, lambda h: h <> stay OR away <= max_months)) > 0 THEN 'met' ELSE 'not_met' END,
  CASE WHEN NOT coalesce(clinical_only, false) THEN NULL WHEN clinical IS NULL THEN 'unsure' WHEN clinical THEN 'met' ELSE 'not_met' END,
  CASE WHEN levels IS NULL THEN NULL WHEN level IS NULL THEN 'unsure' WHEN list_contains(levels, level) THEN 'met' ELSE 'not_met' END,
  CASE WHEN membership IS NOT NULL THEN 'check' END, CASE WHEN len(other_rules) > 0 THEN 'check' END,
  CASE WHEN coalesce(custom, false) THEN 'info' WHEN verified IS NULL THEN 'unsure' WHEN date_diff('day', verified, DATE '2026-10-01') / 30.44::DOUBLE > 12 THEN 'info' END,
  CASE WHEN deadline IS NULL AND NOT coalesce(rolling, false) THEN 'info' END]) AS outcome FROM y),
m AS (SELECT person, id, any_value(name) AS name, CASE WHEN bool_or(outcome = 'not_met') THEN 'not_eligible' WHEN bool_or(outcome = 'unsure') THEN 'possible' ELSE 'eligible' END AS status,
  any_value(CASE WHEN list_has_any(own_fields, coalesce(fields, [])) THEN 2 WHEN fields IS NULL OR list_contains(fields, 'any') THEN 1 ELSE 0 END) AS fit, any_value(deadline) AS deadline, any_value(coalesce(rolling, false)) AS rolling,
  CAST(count(*) FILTER (outcome = 'unsure') AS INTEGER) AS n_unsure FROM r JOIN y USING (person, id) GROUP BY person, id),
k AS (SELECT *, CAST(date_diff('day', DATE '2026-10-01', deadline) AS INTEGER) AS days_left FROM m)"""


def _match(s, d):
    return funding.match(people(s, d), calls(s), TODAY)


def _rule(rule):
    def run(s, d):
        return funding.outcomes(people(s, d), calls(s), TODAY, rule)

    return run, f"{BOTH} SELECT person, id, rule, outcome FROM r WHERE rule = '{rule}' AND outcome IS NOT NULL"


def steps(spark, sf_dir):
    """Events as steps of applications: a user's events in one hour belong to one call."""
    name = F.element_at(F.array(*[F.lit(c["id"]) for c in _LIST]), F.pmod(F.col("event_id") * 0 + F.hour("ts"), F.lit(6)).cast("int") + 1)
    kind = F.create_map(*[F.lit(x) for p in (("view", "interested"), ("click", "preparing"), ("signup", "submitted"), ("error", "rejected"), ("purchase", "awarded")) for x in p])[F.col("event_type")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("person"), name.alias("id"), kind.alias("status"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"))


STAGES_SQL = f"""e AS (SELECT concat('Customer#', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS person, [{', '.join(repr(c['id']) for c in _LIST)}][hour(ts) % 6 + 1] AS id, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 END AS place FROM events),
g AS (SELECT person, id, ['interested', 'preparing', 'submitted', 'interview', 'rejected', 'awarded'][max(place)] AS status, min(day) AS since FROM e GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN status IN ('interested', 'preparing') THEN 'open' WHEN status IN ('submitted', 'interview') THEN 'waiting' ELSE 'decided' END AS band FROM g)"""
PLAN_SQL = f"""q AS (SELECT *, {_next} AS goal FROM calls),
pl AS (SELECT id, step, max(due) AS due FROM (
  SELECT id, 'ask_referees' AS step, goal - 56 AS due FROM q WHERE goal IS NOT NULL AND category <> 'travel' UNION ALL SELECT id, 'first_draft', goal - 28 FROM q WHERE goal IS NOT NULL AND category <> 'travel'
  UNION ALL SELECT id, 'ask_host_letter', goal - 84 FROM q WHERE goal IS NOT NULL AND host_letter UNION ALL SELECT id, 'host_letter_signed', goal - 21 FROM q WHERE goal IS NOT NULL AND host_letter
  UNION ALL SELECT id, 'travel_draft', goal - 21 FROM q WHERE goal IS NOT NULL AND category = 'travel' UNION ALL SELECT id, 'travel_final', goal - 7 FROM q WHERE goal IS NOT NULL AND category = 'travel'
  UNION ALL SELECT id, 'check_documents', goal - 7 FROM q WHERE goal IS NOT NULL UNION ALL SELECT id, 'deadline', goal FROM q WHERE goal IS NOT NULL
  UNION ALL SELECT id, d.kind, d.date FROM (SELECT id, goal, unnest(deadlines) AS d FROM q) WHERE d.kind <> 'final' AND d.date BETWEEN DATE '2026-10-01' AND goal) GROUP BY 1, 2)"""
_W = f"WITH calls AS ({CALLS_SQL})"


def _done(s, d):
    return funding.stage(steps(s, d)).where("substr(person, -1) = '7'").select("person", "id", F.lit("check_documents").alias("step"))


QUERIES = {f"fel{n:02d}_{rule}": _rule(rule) for n, rule in ((2, "career_stage"), (3, "nationality"), (4, "residence"), (5, "host"), (6, "mobility"), (7, "clinical"), (7, "level"), (8, "membership"), (8, "other_rules"), (9, "deadline"), (10, "verified"))}
QUERIES |= {
    "fel01_next_deadline": (lambda s, d: calls(s).select("id", funding.deadline(TODAY).alias("deadline")), f"{_W} SELECT id, {_next} AS deadline FROM calls"),
    "fel11_match": (lambda s, d: _match(s, d), f"{BOTH} SELECT person, id, name, status, fit, deadline, days_left, n_unsure, rolling FROM k"),
    "fel12_fit": (lambda s, d: _match(s, d).groupBy("id", "fit").agg(F.count("*").alias("n")), f"{BOTH} SELECT id, fit, count(*) AS n FROM k GROUP BY 1, 2"),
    "fel13_rank": (
        lambda s, d: funding.rank(_match(s, d)).select("person", "id", "place"),
        f"""{BOTH} SELECT person, id, CAST(row_number() OVER (PARTITION BY person ORDER BY CASE status WHEN 'eligible' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END, fit DESC, CASE WHEN deadline IS NOT NULL OR rolling THEN 0 ELSE 1 END,
            coalesce(days_left, 1000000), lower(name), id) AS INTEGER) AS place FROM k""",
    ),
    "fel09_expected": (lambda s, d: funding.expected(calls(s), TODAY), "SELECT 'zeta' AS id, DATE '2027-02-01' AS expected"),
    "fel14_plan": (lambda s, d: funding.plan(calls(s), TODAY), f"{_W}, {PLAN_SQL} SELECT id, step, due FROM pl"),
    "fel16_stage": (lambda s, d: funding.stage(steps(s, d)), f"WITH {STAGES_SQL} SELECT person, id, status, band, since FROM s"),
    "fel17_reminders": (
        lambda s, d: funding.reminders(funding.stage(steps(s, d)), calls(s), _done(s, d), TODAY, 60),
        f"""{_W}, {PLAN_SQL}, {STAGES_SQL} SELECT person, id, step, due, CASE WHEN due < DATE '2026-10-01' THEN 'overdue' WHEN due <= DATE '2026-10-15' THEN 'soon' ELSE 'upcoming' END AS urgency
            FROM s JOIN pl USING (id) WHERE band = 'open' AND due <= DATE '2026-11-30' AND NOT (step = 'check_documents' AND person LIKE '%7')""",
    ),
    "fel18_funnel": (
        lambda s, d: funding.funnel(funding.stage(steps(s, d))),
        f"""WITH {STAGES_SQL} SELECT count(*) AS started, count(*) FILTER (status IN ('submitted', 'interview', 'awarded', 'rejected')) AS submitted, count(*) FILTER (status = 'interview') AS interviews, count(*) FILTER (status = 'awarded') AS awarded,
            count(*) FILTER (band = 'decided') AS decided, round(count(*) FILTER (status = 'awarded') / nullif(count(*) FILTER (band = 'decided'), 0), 6) AS success FROM s""",
    ),
    "fel19_calendar": (
        lambda s, d: funding.calendar(funding.stage(steps(s, d)), _match(s, d), calls(s), TODAY),
        f"""{BOTH}, {STAGES_SQL}, dd AS (SELECT id, d.date AS day, d.kind AS kind FROM (SELECT id, unnest(deadlines) AS d FROM calls) WHERE d.date >= DATE '2026-10-01')
            SELECT person, id, day, kind, true AS mine FROM s JOIN dd USING (id) WHERE band <> 'decided' UNION SELECT k.person, k.id, day, kind, false FROM k JOIN dd USING (id) ANTI JOIN s ON k.person = s.person AND k.id = s.id WHERE k.status <> 'not_eligible' AND kind = 'final'""",
    ),
    "fel30_months": (
        lambda s, d: funding.months(funding.calendar(funding.stage(steps(s, d)), _match(s, d), calls(s), TODAY)),
        f"""{BOTH}, {STAGES_SQL}, dd AS (SELECT id, d.date AS day, d.kind AS kind FROM (SELECT id, unnest(deadlines) AS d FROM calls) WHERE d.date >= DATE '2026-10-01'), z AS (
            SELECT person, id, day, kind, true AS mine FROM s JOIN dd USING (id) WHERE band <> 'decided' UNION SELECT k.person, k.id, day, kind, false FROM k JOIN dd USING (id) ANTI JOIN s ON k.person = s.person AND k.id = s.id WHERE k.status <> 'not_eligible' AND kind = 'final')
            SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n, count(DISTINCT day) AS n_days, bool_or(mine) AS mine FROM z GROUP BY 1""",
    ),
    "fel29_detail_dates": (
        lambda s, d: funding.detail_dates(calls(s), TODAY),
        f"""{_W}, u AS (SELECT id, unnest(deadlines) AS d FROM calls), f AS (SELECT id, d.kind AS kind, d.date AS day FROM u WHERE d.date >= DATE '2026-10-01')
            SELECT id, kind, day, false AS last_call FROM f UNION ALL SELECT id, 'final', max(d.date), true FROM u WHERE d.kind = 'final' AND id NOT IN (SELECT id FROM f) GROUP BY id""",
    ),
    "fel31_moved": (
        lambda s, d: funding.moved(funding.stage(steps(s, d)).select("person", "id", F.lit(D("2026-11-20")).alias("deadline_seen")), calls(s), TODAY),
        f"{_W}, {STAGES_SQL}, n AS (SELECT id, {_next} AS now FROM calls) SELECT person, id, DATE '2026-11-20' AS seen, now FROM s JOIN n USING (id) WHERE now IS DISTINCT FROM DATE '2026-11-20'",
    ),
    "fel32_countdown": (
        lambda s, d: calls(s).select("id", funding.countdown(funding.deadline(TODAY), TODAY).alias("text")).where("text is not null"),
        f"{_W} SELECT id, concat('in ', date_diff('day', DATE '2026-10-01', {_next}), ' days') AS text FROM calls WHERE {_next} IS NOT NULL",
    ),
    "src16_problems": (
        lambda s, d: funding.problems(calls(s).unionByName(calls(s).where("id = 'beta'").withColumns({"category": F.lit("other"), "residence": F.array(F.lit("x")), "min_years": F.lit(20.0)}))),
        "SELECT * FROM (VALUES ('beta', 'bad_category'), ('beta', 'bad_country'), ('beta', 'bad_years'), ('beta', 'repeated_id')) t(id, problem)",
    ),
    "src15_merge": (
        lambda s, d: funding.merge(calls(s), calls(s).where("id = 'beta'").withColumn("name", F.lit("new")), calls(s).where("id = 'zeta'").withColumn("id", F.lit("custom-1"))).select("id", "name"),
        f"{_W} SELECT id, CASE WHEN id = 'beta' THEN 'new' ELSE name END AS name FROM calls UNION ALL SELECT 'custom-1', 'Zeta'",
    ),
    "fel24_measured": (
        lambda s, d: funding.measured(s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS doc", "CAST(n_chars AS INT) AS words", "CAST(n_chars % 9 AS INT) AS pages", "1.9D + (doc_id % 3) / 10D AS min_margin", "array(named_struct('pt', 9D, 'chars', doc_id % 40), named_struct('pt', 11D, 'chars', n_chars)) AS sizes"),
                                      s.sql("SELECT 2000 AS max_words, 5 AS max_pages, 2D AS min_margin_cm, 10D AS min_pt")),
        """SELECT doc_id AS doc, rule, outcome FROM (SELECT doc_id, unnest(['words', 'pages', 'margin', 'text_size']) AS rule, unnest([CASE WHEN n_chars > 2000 THEN 'fail' ELSE 'ok' END, CASE WHEN n_chars % 9 > 5 THEN 'fail' ELSE 'ok' END,
           CASE WHEN 1.9::DOUBLE + (doc_id % 3) / 10::DOUBLE < 1.95::DOUBLE THEN 'fail' ELSE 'ok' END, CASE WHEN doc_id % 40 = 0 THEN 'ok' WHEN doc_id % 40 <= 0.02 * (doc_id % 40 + n_chars) THEN 'warn' ELSE 'fail' END]) AS outcome FROM documents)""",
    ),
}
