"""Queries over projects (labelled documents and conversations stand for them), reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import projects
from veldspar.sources import sinks

from . import funding as calls_plan
from . import manuscripts as papers

_KIND = "CASE source WHEN 'src0' THEN 'Seq' WHEN 'src1' THEN 'seq' ELSE 'imaging' END"
_DAY = "DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER)"


def analyses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return docs.selectExpr("lang AS project", "concat('s', doc_id % 50) AS sample", f"{_KIND} AS kind", "CASE WHEN quality = 1 THEN 'done' WHEN toxic = 1 THEN 'failed' END AS status", f"{_DAY} AS day")


A = f"WITH a AS (SELECT lang AS project, concat('s', doc_id % 50) AS sample, {_KIND} AS kind, CASE WHEN quality = 1 THEN 'done' WHEN toxic = 1 THEN 'failed' END AS status, {_DAY} AS day FROM documents JOIN labels USING (doc_id))"


def notes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("CAST(conv_id AS STRING) AS project", "turn AS note", "DATE '2026-01-01' + CAST(conv_id % 300 AS INT) AS day", "text", "array(role, concat('s', turn)) AS samples")


N = "WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS project, turn AS note, DATE '2026-01-01' + CAST(conv_id % 300 AS INTEGER) AS day, text, [role, concat('s', turn)] AS samples FROM conversations)"

_EVENT = " || chr(13) || chr(10) || ".join(
    ["'BEGIN:VEVENT'", "'UID:' || id || '-' || kind || '-' || strftime(day, '%Y%m%d') || '@veldspar'", "'DTSTAMP:20261001T000000Z'", "'DTSTART;VALUE=DATE:' || strftime(day, '%Y%m%d')", "'DTEND;VALUE=DATE:' || strftime(day + 1, '%Y%m%d')", "'SUMMARY:' || id || ': ' || kind"]
    + ["'BEGIN:VALARM'", "'ACTION:DISPLAY'", "'DESCRIPTION:' || id || ': ' || kind", "'TRIGGER:-P7D'", "'END:VALARM'", "'END:VEVENT'"]
)
CALENDAR_SQL = f"""SELECT person, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//veldspar//deadlines//EN', 'CALSCALE:GREGORIAN', string_agg({_EVENT}, chr(13) || chr(10) ORDER BY day, id, kind), 'END:VCALENDAR', ''], chr(13) || chr(10)) AS calendar
FROM ({calls_plan.QUERIES["fel19_calendar"][1]}) GROUP BY person"""
QUERIES = {
    "prj03_counts": (lambda s, d: projects.counts(analyses(s, d)), f"{A} SELECT project, lower(kind) AS kind, NULL AS status, count(DISTINCT sample) AS n_samples FROM a GROUP BY 1, 2 UNION ALL SELECT project, lower(kind), status, count(DISTINCT sample) FROM a WHERE status IS NOT NULL GROUP BY 1, 2, 3"),
    "prj05_home": (lambda s, d: projects.home(analyses(s, d)), f"{A}, g AS (SELECT project, count(DISTINCT sample) AS samples, count(*) FILTER (status = 'done') AS done, max(day) AS day FROM a GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY day DESC NULLS LAST, project) AS INTEGER) AS place FROM g"),
    "prj01_upsert": (
        lambda s, d: projects.upsert(analyses(s, d), analyses(s, d).where("kind = 'Seq'").withColumn("status", F.lit("running"))).groupBy("kind", "status").agg(F.count("*").alias("n")),
        f"{A}, c AS (SELECT DISTINCT project, sample FROM a WHERE kind = 'Seq') SELECT kind, status, count(*) AS n FROM (SELECT kind, status FROM a WHERE NOT (lower(kind) = 'seq' AND (project, sample) IN (SELECT (project, sample) FROM c)) UNION ALL SELECT kind, 'running' FROM a WHERE kind = 'Seq') GROUP BY 1, 2",
    ),
    "flt09_notes": (lambda s, d: projects.find_notes(notes(s, d), "assistant"), f"{N} SELECT project, note, strftime(day, '%B %Y') AS month FROM n WHERE contains(lower(concat_ws(' ', text, samples[1], samples[2])), 'assistant')"),
    "prj04_notes_for": (lambda s, d: projects.notes_for(notes(s, d), "s2").select("project", "note"), f"{N} SELECT project, note FROM n WHERE list_contains(samples, 's2')"),
    "prj04_unknown": (
        lambda s, d: projects.unknown_samples(notes(s, d), notes(s, d).where("note < 2").select("project", F.explode("samples").alias("sample"))),
        f"{N}, u AS (SELECT DISTINCT project, note, unnest(samples) AS sample FROM n) SELECT DISTINCT project, sample FROM u WHERE (project, sample) NOT IN (SELECT (project, sample) FROM u WHERE note < 2)",
    ),
    "prj06_colours": (lambda s, d: notes(s, d).groupBy(projects.colour(F.col("note")).alias("colour")).agg(F.count("*").alias("n")), f"{N} SELECT note % 6 AS colour, count(*) AS n FROM n GROUP BY 1"),
    "prj07_slugs": (
        lambda s, d: projects.slugs(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))),
        "SELECT name, seq, CASE WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS slug FROM (SELECT p_name AS name, p_partkey AS seq, replace(lower(p_name), ' ', '-') AS base, row_number() OVER (PARTITION BY replace(lower(p_name), ' ', '-') ORDER BY p_partkey) AS n FROM part)",
    ),
    "snk01_text_report": (lambda s, d: sinks.text_report(papers.m.run(papers.paragraphs(s, d), ["figures"])), None),
    "snk02_json_report": (lambda s, d: sinks.json_report(papers.m.run(papers.paragraphs(s, d), ["statements"])), None),
    "snk07_calendar": (lambda s, d: sinks.calendar(calls_plan.funding.calendar(calls_plan.funding.stage(calls_plan.steps(s, d)), calls_plan._match(s, d), calls_plan.calls(s), calls_plan.TODAY), calls_plan.TODAY), CALENDAR_SQL),
    "snk06_sample_sheet": (
        lambda s, d: sinks.sample_sheet(analyses(s, d).groupBy("sample", "kind").agg(F.max("status").alias("status")), ["Seq", "imaging"]),
        f"{A} SELECT sample, max(status) FILTER (kind = 'Seq') AS \"Seq status\", max(status) FILTER (kind = 'imaging') AS \"imaging status\" FROM a GROUP BY 1",
    ),
    "run02_status": (lambda s, d: sinks.exit_status(papers.m.run(papers.paragraphs(s, d), ["figures"]), papers.paragraphs(s, d).select("doc_id").distinct().withColumn("error", F.lit(None).cast("string"))), None),
    "flt03_by_check": (lambda s, d: papers.m.run(papers.paragraphs(s, d), ["figures", "statements"]).rollup("check", "severity").agg(F.count("*").alias("n")), None),
}
