"""Funding calls matched to researchers, with three-valued reasons; plans, reminders, funnels and calendars.

Unknown particulars never filter a pair away: every rule yields a reason with an outcome
(met, not_met, unsure, check, info) or null where a call says nothing.  A null
list is unrestricted; an empty one admits nobody.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, MONTH = "365.25D", "30.44D"
#: Days before a deadline at which each step of a plan is due, and the calls it is for.
PLAN = [("ask_referees", 56, "not travel"), ("first_draft", 28, "not travel"), ("ask_host_letter", 84, "host_letter"), ("host_letter_signed", 21, "host_letter"), ("travel_draft", 21, "travel"), ("travel_final", 7, "travel"), ("check_documents", 7, "all")]
SUBMITTED = ("submitted", "interview", "awarded", "rejected")


def deadline(today: date, kind: str = "final") -> Column:
    """The first deadline of a kind on or after a day."""
    return F.array_min(F.transform(F.filter("deadlines", lambda d: (d["kind"] == kind) & (d["date"] >= F.lit(today))), lambda d: d["date"]))


_AT = "coalesce(deadline, today)"
_YEARS = f"datediff({_AT}, phd_date) / {YEAR}"
_LESS = f"({_YEARS} - coalesce(break_months, 0) / 12)"
RULES = {
    "career_stage": f"""CASE WHEN NOT coalesce(phd_required, false) AND min_years IS NULL AND max_years IS NULL THEN NULL
        WHEN phd_date IS NULL AND phd_expected IS NULL THEN 'unsure'
        WHEN phd_date IS NULL THEN CASE WHEN min_years IS NOT NULL AND datediff({_AT}, phd_expected) / {YEAR} < min_years THEN 'not_met' ELSE 'unsure' END
        WHEN {_YEARS} < 0 THEN 'unsure' WHEN {_YEARS} < min_years THEN 'not_met'
        WHEN {_YEARS} > max_years AND coalesce(break_months, 0) > 0 AND {_LESS} <= max_years THEN CASE WHEN breaks_extend THEN 'met' ELSE 'unsure' END
        WHEN {_YEARS} > max_years THEN 'not_met' ELSE 'met' END""",
    "nationality": """CASE WHEN nationalities IS NULL AND excluded_nationalities IS NULL THEN NULL WHEN own_nationalities IS NULL OR size(own_nationalities) = 0 THEN 'unsure'
        WHEN size(array_except(own_nationalities, coalesce(excluded_nationalities, array()))) = 0 THEN 'not_met'
        WHEN nationalities IS NULL OR arrays_overlap(array_except(own_nationalities, coalesce(excluded_nationalities, array())), nationalities) THEN 'met' ELSE 'not_met' END""",
    "residence": "CASE WHEN residence IS NULL THEN NULL WHEN own_residence IS NULL THEN 'unsure' WHEN array_contains(residence, own_residence) THEN 'met' ELSE 'not_met' END",
    "host": """CASE WHEN targets IS NULL THEN CASE WHEN hosts IS NULL THEN NULL ELSE 'unsure' END
        WHEN size(open_targets) = 0 THEN 'not_met' WHEN hosts IS NULL AND NOT coalesce(host_anywhere, false) THEN 'unsure' ELSE 'met' END""",
    "mobility": f"""CASE WHEN max_months IS NULL THEN NULL WHEN stays IS NULL OR targets IS NULL THEN 'unsure'
        WHEN exists(open_targets, h -> aggregate(filter(stays, s -> s.country = h), 0D, (a, s) -> a + greatest(0, datediff(least(coalesce(s.end, {_AT}), {_AT}), greatest(s.start, add_months({_AT}, -12 * window_years)))) / {MONTH}) <= max_months) THEN 'met' ELSE 'not_met' END""",
    "clinical": "CASE WHEN NOT coalesce(clinical_only, false) THEN NULL WHEN clinical IS NULL THEN 'unsure' WHEN clinical THEN 'met' ELSE 'not_met' END",
    "level": "CASE WHEN levels IS NULL THEN NULL WHEN level IS NULL THEN 'unsure' WHEN array_contains(levels, level) THEN 'met' ELSE 'not_met' END",
    "membership": "CASE WHEN membership IS NOT NULL THEN 'check' END",
    "other_rules": "CASE WHEN size(other_rules) > 0 THEN 'check' END",
    "verified": f"CASE WHEN coalesce(custom, false) THEN 'info' WHEN verified IS NULL THEN 'unsure' WHEN datediff(today, verified) / {MONTH} > 12 THEN 'info' END",
    "deadline": "CASE WHEN deadline IS NULL AND NOT coalesce(rolling, false) THEN 'info' END",
}


#: Rows of a list that go to the executors at once.
BLOCK = 20_000


def beside(rows: DataFrame, listed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row beside every row of a list, which goes to the executors in blocks of about `block` rows."""
    n = -(-listed.count() // block)
    if n <= 1:
        return rows.crossJoin(F.broadcast(listed))
    key = F.pmod(F.xxhash64(*[c for c, kind in listed.dtypes if "map<" not in kind]), F.lit(n))
    return reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(listed.where(key == k))) for k in range(n)])


def pairs(people: DataFrame, calls: DataFrame, today: date) -> DataFrame:
    """Each researcher beside each call, with the call's next deadline and the targets that it admits.

    Every pair is asked for (a verdict each), so the calls go to the researchers: a list
    of calls is a few hundred rows whatever the number of researchers.
    """
    own = people.withColumnsRenamed({"nationalities": "own_nationalities", "residence": "own_residence", "fields": "own_fields"})
    both = beside(own, calls.withColumn("deadline", deadline(today))).withColumn("today", F.lit(today))
    admitted = "filter(targets, h -> (hosts IS NULL OR array_contains(hosts, h)) AND NOT array_contains(coalesce(excluded_hosts, array()), h))"
    return both.withColumn("open_targets", F.expr(admitted))


def reasons(people: DataFrame, calls: DataFrame, today: date) -> DataFrame:
    """Pairs with `reasons`, an array of (rule, outcome) without the rules that a call doesn't have."""
    listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(case).alias("outcome")) for rule, case in RULES.items()])
    return pairs(people, calls, today).withColumn("reasons", F.filter(listed, lambda r: r["outcome"].isNotNull()))


def outcomes(people: DataFrame, calls: DataFrame, today: date, rule: str) -> DataFrame:
    """(person, id, rule, outcome) of one rule for every pair of a call that has it; no other rule is worked out."""
    outcome = F.expr(RULES[rule])
    return pairs(people, calls, today).select("person", "id", F.lit(rule).alias("rule"), outcome.alias("outcome")).where("outcome is not null")


def match(people: DataFrame, calls: DataFrame, today: date) -> DataFrame:
    """(person, id, name, status, fit, deadline, days_left, n_unsure): a verdict for every pair."""
    has = lambda o: F.exists("reasons", lambda r: r["outcome"] == o)
    status = F.when(has("not_met"), "not_eligible").when(has("unsure"), "possible").otherwise("eligible")
    fit = F.when(F.arrays_overlap(F.coalesce("own_fields", F.array().cast("array<string>")), F.coalesce("fields", F.array().cast("array<string>"))), 2).when(F.col("fields").isNull() | F.array_contains("fields", "any"), 1).otherwise(0)
    unsure = F.size(F.filter("reasons", lambda r: r["outcome"] == "unsure"))
    return reasons(people, calls, today).select("person", "id", "name", status.alias("status"), F.coalesce(fit, F.lit(0)).alias("fit"), "deadline", F.datediff("deadline", "today").alias("days_left"), unsure.alias("n_unsure"), F.coalesce("rolling", F.lit(False)).alias("rolling"))


def rank(matches: DataFrame) -> DataFrame:
    """Matches in order for each person: status, fit, open ones first, days left, name."""
    order = [F.expr("CASE status WHEN 'eligible' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END"), F.desc("fit"), F.when(F.col("deadline").isNotNull() | F.col("rolling"), 0).otherwise(1), F.coalesce("days_left", F.lit(10**6)), F.lower("name"), "id"]
    return matches.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(*order)))


def expected(calls: DataFrame, today: date) -> DataFrame:
    """(id, expected): the month after a year in which a yearly call without an open deadline should come again."""
    last = F.array_max(F.transform(F.filter("deadlines", lambda d: d["kind"] == "final"), lambda d: d["date"]))
    return calls.where(deadline(today).isNull() & F.col("annual") & last.isNotNull()).select("id", F.make_date(F.year(last) + 1, F.month(last), F.lit(1)).alias("expected"))


def detail_dates(calls: DataFrame, today: date) -> DataFrame:
    """(id, kind, day, last_call): deadlines to come; where none is left, the last final one."""
    coming = F.filter("deadlines", lambda d: d["date"] >= F.lit(today))
    last = F.slice(F.array_sort(F.transform(F.filter("deadlines", lambda d: d["kind"] == "final"), lambda d: F.struct(d["date"].alias("day"), d["kind"].alias("kind")))), -1, 1)
    some = F.when(F.size(coming) > 0, F.transform(coming, lambda d: F.struct(d["date"].alias("day"), d["kind"].alias("kind")))).when(F.exists("deadlines", lambda d: d["kind"] == "final"), last)
    return calls.select("id", (F.size(coming) == 0).alias("last_call"), F.explode(some).alias("d")).select("id", "d.kind", "d.day", "last_call")


def plan(calls: DataFrame, today: date) -> DataFrame:
    """(id, step, due): steps back from each call's next deadline, gates included."""
    goal = calls.withColumn("deadline", deadline(today)).where("deadline is not null")
    wanted = {"all": F.lit(True), "travel": F.col("category") == "travel", "not travel": F.col("category") != "travel", "host_letter": F.coalesce("host_letter", F.lit(False))}
    step = [F.when(wanted[who], F.struct(F.lit(s).alias("step"), F.date_sub("deadline", days).alias("due"))) for s, days, who in PLAN]
    gates = F.transform(F.filter("deadlines", lambda d: (d["kind"] != "final") & (d["date"] >= F.lit(today)) & (d["date"] <= F.col("deadline"))), lambda d: F.struct(d["kind"].alias("step"), d["date"].alias("due")))
    steps = F.concat(F.filter(F.array(*step), lambda s: s.isNotNull()), gates, F.array(F.struct(F.lit("deadline").alias("step"), F.col("deadline").alias("due"))))
    rows = goal.select("id", F.explode(steps).alias("s")).select("id", "s.step", "s.due")
    return rows.groupBy("id", "step").agg(F.max("due").alias("due"))  # of a kind's deadlines in the window the last counts


def stage(applications: DataFrame) -> DataFrame:
    """(person, id, status, band, since) from rows (person, id, status, day, seq): the furthest stage so far."""
    place = F.array_position(F.array(*map(F.lit, ["interested", "preparing", "submitted", "interview", "rejected", "awarded"])), F.col("status"))
    rows = applications.withColumn("place", place).groupBy("person", "id").agg(F.max_by("status", F.struct("place", "seq")).alias("status"), F.min("day").alias("since"))
    return rows.select("person", "id", "status", F.expr("CASE WHEN status IN ('interested', 'preparing') THEN 'open' WHEN status IN ('submitted', 'interview') THEN 'waiting' ELSE 'decided' END").alias("band"), "since")


def start(applications: DataFrame, wanted: DataFrame) -> DataFrame:
    """Applications with the wanted ones that aren't there yet."""
    return applications.unionByName(wanted.join(applications, ["person", "id"], "left_anti").select(*applications.columns))


def funnel(stages: DataFrame) -> DataFrame:
    """One row: how many were started, submitted, interviewed, awarded and decided, and the share awarded."""
    n = lambda c: F.count_if(c)
    reached = F.col("status").isin(*SUBMITTED)
    decided = F.col("status").isin("awarded", "rejected")
    return stages.agg(F.count("*").alias("started"), n(reached).alias("submitted"), n(F.col("status") == "interview").alias("interviews"), n(F.col("status") == "awarded").alias("awarded"), n(decided).alias("decided"), F.round(F.try_divide(n(F.col("status") == "awarded"), n(decided)), 6).alias("success"))


def reminders(stages: DataFrame, calls: DataFrame, done: DataFrame, today: date, within: int = 42, soon: int = 14) -> DataFrame:
    """(person, id, step, due, urgency): undone plan steps of open applications due within some days, or past."""
    left = F.datediff("due", F.lit(today))
    rows = stages.where("band = 'open'").select("person", "id").join(plan(calls, today), "id").join(done, ["person", "id", "step"], "left_anti")
    return rows.where(left <= within).select("person", "id", "step", "due", F.when(left < 0, "overdue").when(left <= soon, "soon").otherwise("upcoming").alias("urgency"))


def moved(seen: DataFrame, calls: DataFrame, today: date) -> DataFrame:
    """(person, id, seen, now) where a call's next deadline isn't the one that was last seen (column deadline_seen)."""
    now = calls.select("id", deadline(today).alias("now"))
    return seen.join(now, "id").where(~F.col("now").eqNullSafe(F.col("deadline_seen"))).select("person", "id", F.col("deadline_seen").alias("seen"), "now")


def calendar(stages: DataFrame, matches: DataFrame, calls: DataFrame, since: date) -> DataFrame:
    """(person, id, day, kind, mine): deadlines of own applications, and final ones of calls that may suit and aren't tracked."""
    days = calls.select("id", F.explode("deadlines").alias("d")).select("id", F.col("d.date").alias("day"), F.col("d.kind").alias("kind")).where(F.col("day") >= F.lit(since))
    own = stages.where("band <> 'decided'").select("person", "id").join(days, "id").withColumn("mine", F.lit(True))
    others = matches.where("status <> 'not_eligible'").select("person", "id").join(stages, ["person", "id"], "left_anti").join(days.where("kind = 'final'"), "id").withColumn("mine", F.lit(False))
    return own.unionByName(others).select("person", "id", "day", "kind", "mine").distinct()


def months(events: DataFrame) -> DataFrame:
    """(month, n, n_days, mine): events by month."""
    return events.groupBy(F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("n_days"), F.bool_or("mine").alias("mine"))


def countdown(day: Column, today: date) -> Column:
    n = F.datediff(day, F.lit(today))
    return F.when(n < 0, F.concat(-n, F.lit(" days ago"))).when(n == 0, "today").when(n == 1, "tomorrow").otherwise(F.concat(F.lit("in "), n, F.lit(" days")))


def problems(calls: DataFrame) -> DataFrame:
    """(id, problem): entries that can't be used, every fault of each."""
    kinds = [
        ("no_id", F.trim(F.coalesce("id", F.lit(""))) == ""), ("no_name", F.trim(F.coalesce("name", F.lit(""))) == ""), ("bad_category", ~F.coalesce(F.col("category").isin("postdoc", "phd", "travel"), F.lit(False))),
        ("bad_country", F.exists(F.flatten(F.array_compact(F.array("nationalities", "excluded_nationalities", "residence", "excluded_hosts"))), lambda c: ~c.rlike("^[A-Z]{2}$"))), ("bad_years", F.col("min_years") > F.col("max_years")),
    ]
    listed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in kinds]), lambda x: x.isNotNull())
    repeated = calls.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    return calls.select("id", F.explode(listed).alias("problem")).unionByName(repeated)


def merge(base: DataFrame, fresh: DataFrame, own: DataFrame) -> DataFrame:
    """Fresh entries replace those of the same id and add to them; own ones are added."""
    kept = base.join(fresh.select("id"), "id", "left_anti").select(*base.columns)
    return kept.unionByName(fresh).unionByName(own)


def measured(document: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, rule, outcome) from measurements (doc, words, pages, min_margin, sizes array<struct<pt, chars>>) and rules (max_words, max_pages, min_margin_cm, min_pt).

    Each row of rules is applied to each document; where rules have a `name`, it stands beside doc.
    """
    both = beside(document, rules)
    small = F.expr("aggregate(filter(sizes, s -> s.pt < min_pt - 0.25), 0L, (a, s) -> a + s.chars)")
    whole = F.expr("aggregate(sizes, 0L, (a, s) -> a + s.chars)")
    over = lambda v, most: F.when(most.isNull(), F.lit(None)).when(v.isNull(), "unsure").when(v > most, "fail").otherwise("ok")
    cases = {
        "words": over(F.col("words"), F.col("max_words")), "pages": over(F.col("pages"), F.col("max_pages")),
        "margin": F.when(F.col("min_margin_cm").isNull(), F.lit(None)).when(F.col("min_margin").isNull(), "unsure").when(F.col("min_margin") < F.col("min_margin_cm") - 0.05, "fail").otherwise("ok"),
        "text_size": F.when(F.col("min_pt").isNull(), F.lit(None)).when(small == 0, "ok").when(small <= 0.02 * whole, "warn").otherwise("fail"),
    }
    named = [c for c in rules.columns if c == "name"]
    return both.select("doc", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("outcome")) for k, v in cases.items()]), lambda r: r["outcome"].isNotNull())).alias("r"), *named).select("doc", *named, "r.rule", "r.outcome")
