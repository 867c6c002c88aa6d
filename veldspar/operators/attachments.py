"""Application documents: what can be measured in each, held against what a call asks for.

A document's paragraphs carry their runs of text with sizes; a file's own row says what kind it is, how many pages it has and how
wide its margins are, or why it couldn't be read.  Requirements are rows, one for each document that an application needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a paragraph that may be a heading, points and centimetres that don't count, the share of small text that may be.
LEAD, SLACK_PT, SLACK_CM, SMALL = 70, 0.25, 0.05, 0.02
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'’-]*"
SIDES = ("left", "right", "top", "bottom")
FINDING = ["app", "name", "rule", "outcome", "detail"]


def measured(paragraphs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, kind, pages, margins, error, words, sizes) of every file.

    paragraphs: (doc_id, idx, text, is_heading, runs array<struct<size, chars, raised>>); files: (doc_id, kind, pages, margins, error).
    Words of headings aren't counted.  sizes maps each size to its characters, raised and lowered text aside; runs without a size or characters
    are left out.  A file without paragraphs has no words and no sizes; paragraphs without a file are left out.
    """
    text = F.when(~F.coalesce("is_heading", F.lit(False)), F.coalesce("text", F.lit(""))).otherwise("")
    words = paragraphs.groupBy("doc_id").agg(F.sum(F.regexp_count(text, F.lit(WORD))).cast("long").alias("words"))
    runs = paragraphs.select("doc_id", F.explode("runs").alias("r")).where("not coalesce(r.raised, false) and r.size is not null and r.chars > 0")
    sizes = runs.groupBy("doc_id", F.col("r.size").alias("size")).agg(F.sum("r.chars").cast("long").alias("chars"))
    per = sizes.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "chars")))).alias("sizes"))  # the sizes of one document
    return files.select("doc_id", "kind", "pages", "margins", "error").join(words, "doc_id", "left").join(per, "doc_id", "left").withColumns({"words": F.coalesce("words", F.lit(0).cast("long")), "sizes": F.coalesce("sizes", F.create_map().cast("map<double,bigint>"))})


def _ordered(c: Column) -> Column:
    """A pattern for the words of a requirement in order, small words aside."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda w: ~w.isin("and", "of", "the"))
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), ".*"))


def sections(paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, section) of the wanted ones (doc_id, section) that a document has: a heading, or the first characters of a paragraph, hold its words in order."""
    said = F.lower(F.when(F.coalesce("is_heading", F.lit(False)), F.col("text")).otherwise(F.left("text", F.lit(LEAD))))
    asked = wanted.where("doc_id is not null").distinct().withColumn("rx", _ordered(F.col("section"))).groupBy("doc_id").agg(F.collect_list(F.struct("section", "rx")).alias("asked"))  # what is asked of one document
    rows = paragraphs.where("text <> ''").select("doc_id", said.alias("said")).join(asked, "doc_id")
    return rows.select("doc_id", F.explode(F.filter("asked", lambda a: F.rlike(F.col("said"), a["rx"]))).alias("a")).select("doc_id", "a.section").distinct()


def _finding(rule: str, outcome: Column, detail: Column) -> Column:
    return F.when(outcome.isNotNull(), F.struct(F.lit(rule).alias("rule"), outcome.alias("outcome"), detail.cast("string").alias("detail")))


def _limits() -> list[Column]:
    """A finding for each rule that a requirement sets, over its row beside the document's measures."""
    total = F.aggregate(F.map_values("sizes"), F.lit(0).cast("long"), lambda a, n: a + n)
    small = F.filter(F.map_entries("sizes"), lambda e: e["key"] < F.col("min_font_size") - SLACK_PT)
    little = F.aggregate(small, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    narrow = F.filter(F.array(*[F.lit(s) for s in SIDES]), lambda s: F.try_element_at("margins", s) < F.col("min_margin_cm") - SLACK_CM)
    known = F.col("margins").isNotNull() & (F.size(F.coalesce(F.map_keys("margins"), F.array().cast("array<string>"))) > 0)
    other = F.col("file_format").isNotNull() & (F.col("file_format") != F.col("kind"))
    return [
        _finding("format", F.when(other, F.when(F.col("file_format") == "pdf", "info").otherwise("fail")), F.col("file_format")),
        _finding("pages", F.when(F.col("max_pages").isNull(), F.lit(None)).when(F.col("pages").isNull(), "warn").when(F.col("pages") > F.col("max_pages"), "fail").otherwise("pass"), F.concat_ws("/", "pages", "max_pages")),
        _finding("words", F.when(F.col("max_words").isNotNull(), F.when(F.col("words") > F.col("max_words"), "fail").otherwise("pass")), F.concat_ws("/", "words", "max_words")),
        _finding("text_size", F.when((F.col("min_font_size") > 0) & (total > 0), F.when(F.size(small) == 0, "pass").when(little <= SMALL * total, "warn").otherwise("fail")), F.array_min(F.map_keys("sizes"))),
        _finding("margins", F.when((F.col("min_margin_cm") > 0) & known, F.when(F.size(narrow) > 0, "fail").otherwise("pass")), F.array_join(narrow, ",")),
    ]


def checked(required: DataFrame, measures: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(app, name, rule, outcome, detail): what each required document passes (pass), fails (fail) or leaves open (warn, info).

    required: (app, name, doc_id, file_format, max_pages, max_words, sections, min_font_size, min_margin_cm); doc_id is null where nothing is attached.
    A document that isn't attached, that no file holds any more, or that couldn't be read fails and isn't looked at further; a rule that isn't set
    gives nothing, and a limit of pages that can't be counted is a warn.
    """
    held = required.join(measures, "doc_id", "left")
    state = F.when(F.col("doc_id").isNull(), "not_attached").when(F.col("kind").isNull() & F.col("error").isNull(), "not_found").when(F.col("error").isNotNull(), "unreadable")
    marked = held.withColumn("state", state)
    bad = marked.where("state is not null").select("app", "name", F.col("state").alias("rule"), F.lit("fail").alias("outcome"), F.coalesce("error", F.lit("")).alias("detail"))
    good = marked.where("state is null")
    limits = good.select("app", "name", F.explode(F.array_compact(F.array(*_limits()))).alias("f")).select("app", "name", "f.*")
    asked = good.select("app", "name", "doc_id", F.explode(F.array_distinct("sections")).alias("section"))
    there = sections(paragraphs, asked.select("doc_id", "section")).withColumn("there", F.lit(True))
    found = asked.join(there, ["doc_id", "section"], "left").select("app", "name", F.lit("section").alias("rule"), F.when(F.col("there"), "pass").otherwise("fail").alias("outcome"), F.col("section").alias("detail"))
    return bad.unionByName(limits).unionByName(found)


def reminders(applications: DataFrame) -> DataFrame:
    """(app, name, rule, outcome, detail) that no file shows: the form of the CV, the host's letter, or that nothing is asked for.

    applications: (app, cv_format, cv_notes, host_letter, n_documents).
    """
    told = F.array_compact(
        F.array(
            F.when(F.col("cv_format").isin("narrative", "funder_template"), F.struct(F.concat(F.lit("cv_"), "cv_format").alias("rule"), F.coalesce("cv_notes", F.lit("")).alias("detail"))),
            F.when(F.col("host_letter"), F.struct(F.lit("host_letter").alias("rule"), F.lit("").alias("detail"))),
            F.when(F.coalesce("n_documents", F.lit(0)) == 0, F.struct(F.lit("nothing_asked").alias("rule"), F.lit("").alias("detail"))),
        )
    )
    return applications.select("app", F.lit(None).cast("string").alias("name"), F.explode(told).alias("f")).select("app", "name", "f.rule", F.lit("info").alias("outcome"), "f.detail")


def readiness(findings: DataFrame) -> DataFrame:
    """(app, problems, warnings, ready) of every application with findings; it is ready without a fail."""
    rows = findings.groupBy("app").agg(F.count_if(F.col("outcome") == "fail").alias("problems"), F.count_if(F.col("outcome") == "warn").alias("warnings"))
    return rows.withColumn("ready", F.col("problems") == 0)
