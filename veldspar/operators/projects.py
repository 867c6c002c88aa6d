"""Projects: analyses of samples, notebooks, counts and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOURS = 6


def upsert(analyses: DataFrame, changed: DataFrame) -> DataFrame:
    """Analyses (project, sample, kind, ...) with the changed ones in place of those of the same kind, whatever its case."""
    key = [F.lower("kind").alias("k")]
    old = analyses.select("*", *key).join(changed.select("project", "sample", *key), ["project", "sample", "k"], "left_anti").select(*analyses.columns)
    return old.unionByName(changed)


def counts(analyses: DataFrame) -> DataFrame:
    """(project, kind, status, n_samples): samples by kind and status; a null status stands for any."""
    rows = analyses.select("project", F.lower("kind").alias("kind"), "status", "sample")
    sets = rows.groupingSets([[F.col("project"), F.col("kind")], [F.col("project"), F.col("kind"), F.col("status")]], "project", "kind", "status")
    return sets.agg(F.countDistinct("sample").alias("n_samples"), F.grouping_id().alias("g")).where("g > 0 or status is not null").select("project", "kind", "status", "n_samples")


def home(analyses: DataFrame) -> DataFrame:
    """(project, samples, done, place): projects with their samples and finished analyses, the newest first."""
    rows = analyses.groupBy("project").agg(F.countDistinct("sample").alias("samples"), F.count_if(F.col("status") == "done").alias("done"), F.max("day").alias("day"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("day").desc_nulls_last(), "project")))


def find_notes(notes: DataFrame, text: str) -> DataFrame:
    """(project, note, month): notes (project, note, day, text, samples) that hold a text, under their month."""
    hay = F.lower(F.concat_ws(" ", "text", F.array_join("samples", " ")))
    return notes.where(F.contains(hay, F.lit(text.lower()))).select("project", "note", F.date_format("day", "MMMM yyyy").alias("month"))


def notes_for(notes: DataFrame, sample: str) -> DataFrame:
    return notes.where(F.array_contains("samples", sample))


def unknown_samples(notes: DataFrame, samples: DataFrame) -> DataFrame:
    """(project, sample): samples that notes name and the project lacks."""
    return notes.select("project", F.explode("samples").alias("sample")).distinct().join(samples.select("project", "sample"), ["project", "sample"], "left_anti")


def colour(seq: Column) -> Column:
    return F.pmod(seq, F.lit(COLOURS))


def slugs(names: DataFrame) -> DataFrame:
    """(name, seq, slug): ids from names, numbered from 2 where they collide."""
    base = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    rows = names.withColumn("base", F.coalesce(F.nullif(base, F.lit("")), F.lit("project"))).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("seq")))
    return rows.select("name", "seq", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"))
