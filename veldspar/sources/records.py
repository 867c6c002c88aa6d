"""Records kept as JSON: lists that a release ships, lists and profiles that people keep, and what `sinks.store` writes.

A shipped list must be whole, so one bad file stops the load and is named.  What people keep is read as far as it goes: a damaged file or line is a
row of problems and never hides another.  Files are parsed where they lie; nothing but the names of bad shipped files comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.journals import RAW, read_raw

# Fixed values of the files: what kinds, levels, fields and dates an entry may name.
CATEGORIES = "postdoc phd travel".split()
LEVELS = "masters_student phd_student postdoc faculty".split()
TRACKS = "any clinical non_clinical".split()
PURPOSES = "conference lab_visit course fieldwork other".split()
DATES = "final internal pre_proposal call_opens".split()
FIELDS = "any molecular_cell_biology neuroscience immunology_infection genetics_genomics ecology_evolution plant_science microbiology structural_biology bioinformatics biomedical_clinical".split()
DEFAULT_LEVELS = {"phd": ["masters_student", "phd_student"]}

_CALL = (
    "id string, name string, funder string, url string, verified string, category string, purpose string, fields array<string>, track string, career_levels array<string>, "
    "career_stage struct<phd_required: string, min_years_since_phd: string, max_years_since_phd: string, career_breaks_extend: string>, nationalities string, excluded_nationalities string, residence string, host_countries string, "
    "excluded_host_countries string, mobility struct<max_months_in_host: string, window_years: string>, deadlines array<struct<kind: string, date: string, estimated: string>>, rolling string, annual string, membership string, "
    "other_rules array<string>, requirements struct<host_letter: string>, template string, custom string, _broken string"
)
_PERSON = (
    "phd_date string, phd_expected string, career_break_months string, nationalities string, residence string, stays array<struct<country: string, start: string, end: string>>, fields array<string>, clinical string, "
    "target_hosts string, career_level string, _broken string"
)


# One value


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def day(c: Column) -> Column:
    """A date written 2026-01-31; anything else is null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def _bad_day(c: Column) -> Column:
    return _given(c).isNotNull() & day(c).isNull()


def _true(c: Column, missing: bool = False) -> Column:
    return F.coalesce(~F.lower(c).isin("", "false", "0", "null"), F.lit(missing))


def _codes(c: Column) -> Column:
    """The texts of a JSON array, upper-case: null where the field is missing."""
    return F.transform(F.from_json(c, "array<string>"), lambda x: F.upper(F.trim(x)))


def _bad_codes(c: Column) -> Column:
    """Whether a field holds something else than a list of two-letter codes."""
    return c.isNotNull() & (~c.rlike(r"^\s*\[") | F.coalesce(F.exists(_codes(c), lambda x: ~F.coalesce(x.rlike(r"^\p{L}{2}$"), F.lit(False))), F.lit(True)))


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _bad_number(c: Column) -> Column:
    return c.isNotNull() & _number(c).isNull()


def _outside(c: Column, known: list[str]) -> Column:
    return F.exists(c, lambda x: ~F.coalesce(x.isin(known), F.lit(False)))


def _problems(*cases: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in cases]))


def _parsed(raw: DataFrame, shape: str) -> DataFrame:
    """The raw rows with `p`, the object that a file holds, and `whole`, whether it is one."""
    p = F.from_json("content", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = raw.withColumn("p", p)
    return rows.withColumn("whole", F.coalesce(F.col("p").isNotNull() & F.col("p._broken").isNull() & F.col("content").rlike(r"^\s*\{"), F.lit(False)))


# Calls


def calls(raw: DataFrame) -> DataFrame:
    """Funding calls of files (layer, file, content) in the columns of schemas.CALL, with layer, file, template and `problems`, all that is wrong with each.

    A call needs an id and a name, and unless it is somebody's own a funder and a page.  No career_stage sets no rule of stage, and one alone
    asks for a doctorate.  A list of countries that is left out restricts nothing; hosts that are ["any"] are anywhere, which isn't the same as unsaid.
    """
    rows = _parsed(raw, _CALL)
    p = lambda c: F.col(f"p.{c}")
    custom, stage = _true(p("custom")), p("career_stage")
    # an object with other fields only is a section too
    any_host = F.coalesce(_codes(p("host_countries")) == F.array(F.lit("ANY")), F.lit(False))
    category, levels = F.coalesce(p("category"), F.lit("postdoc")), p("career_levels")
    default = F.coalesce(*[F.when(category == k, F.array(*map(F.lit, v))) for k, v in DEFAULT_LEVELS.items()], F.array().cast("array<string>"))
    fields = F.when(F.size(F.coalesce(p("fields"), F.array().cast("array<string>"))) > 0, p("fields")).otherwise(F.array(F.lit("any")))
    dates = F.coalesce(p("deadlines"), F.array().cast("array<struct<kind:string,date:string,estimated:string>>"))
    kind = lambda d: F.coalesce(d["kind"], F.lit("final"))
    bad = _problems(
        ("not an object", ~F.col("whole")), ("id", F.col("whole") & p("id").isNull()), ("name", F.col("whole") & (p("name").isNull() | (custom & _given(p("name")).isNull()))), ("funder", F.col("whole") & ~custom & p("funder").isNull()), ("url", F.col("whole") & ~custom & p("url").isNull()),
        ("category", ~category.isin(CATEGORIES)), ("fields", _outside(fields, FIELDS)), ("career_levels", _outside(levels, LEVELS)), ("purpose", ~p("purpose").isin(PURPOSES)), ("track", ~p("track").isin(TRACKS)), ("verified", _bad_day(p("verified"))),
        ("deadline kind", F.exists(dates, lambda d: ~kind(d).isin(DATES))), ("deadline date", F.exists(dates, lambda d: day(d["date"]).isNull())), ("career_stage", _bad_number(stage["min_years_since_phd"]) | _bad_number(stage["max_years_since_phd"])),
        ("mobility", p("mobility").isNotNull() & (_number(p("mobility.max_months_in_host")).isNull() | _number(p("mobility.window_years")).isNull())),
        *[(c, _bad_codes(p(c))) for c in ("nationalities", "excluded_nationalities", "residence", "excluded_host_countries")], ("host_countries", ~any_host & _bad_codes(p("host_countries"))),
    )
    listed = F.array_sort(F.transform(dates, lambda d: F.struct(day(d["date"]).alias("date"), kind(d).alias("kind"), _true(d["estimated"]).alias("estimated"))))
    none = F.array().cast("array<string>")
    return rows.select(
        "layer", "file", p("id").alias("id"), p("name").alias("name"), category.alias("category"), p("purpose").alias("purpose"), fields.alias("fields"), F.when(p("track") == "clinical", True).alias("clinical_only"),
        F.when(stage.isNotNull(), _true(stage["phd_required"], True)).alias("phd_required"), _number(stage["min_years_since_phd"]).alias("min_years"), _number(stage["max_years_since_phd"]).alias("max_years"), _true(stage["career_breaks_extend"]).alias("breaks_extend"),
        _codes(p("nationalities")).alias("nationalities"), F.nullif(_codes(p("excluded_nationalities")), none).alias("excluded_nationalities"), _codes(p("residence")).alias("residence"), F.when(~any_host, _codes(p("host_countries"))).alias("hosts"), any_host.alias("host_anywhere"),
        F.nullif(_codes(p("excluded_host_countries")), none).alias("excluded_hosts"), _number(p("mobility.max_months_in_host")).cast("int").alias("max_months"), _number(p("mobility.window_years")).cast("int").alias("window_years"),
        F.transform(listed, lambda d: F.struct(d["kind"].alias("kind"), d["date"].alias("date"), d["estimated"].alias("estimated"))).alias("deadlines"), _true(p("rolling")).alias("rolling"), _true(p("annual"), True).alias("annual"),
        F.nullif(F.coalesce(levels, default), none).alias("levels"), _given(p("membership")).alias("membership"), F.coalesce(p("other_rules"), none).alias("other_rules"), _true(p("requirements.host_letter")).alias("host_letter"), day(p("verified")).alias("verified"),
        custom.alias("custom"), _true(p("template")).alias("template"), bad.alias("problems"),
    )


def shipped(entries: DataFrame, templates: bool = False, named: int = 20) -> DataFrame:
    """The entries of a shipped list, of `calls`, without templates.  One that can't be used raises ValueError with the names of up to `named` such files."""
    bad = entries.where(F.size("problems") > 0).select("file", F.array_join("problems", ", ").alias("why")).orderBy("file").limit(named).collect()
    if bad:
        raise ValueError("; ".join(f"{r.file}: {r.why}" for r in bad))
    return entries.where(F.lit(templates) | ~F.col("template")).drop("problems", "template")


def usable(entries: DataFrame, templates: bool = False) -> DataFrame:
    """The entries without problems, for lists that people keep."""
    return entries.where((F.size("problems") == 0) & (F.lit(templates) | ~F.col("template"))).drop("problems", "template")


def damaged(entries: DataFrame) -> DataFrame:
    """(layer, file, problem): what is wrong with what can't be used, a row for each problem."""
    return entries.select("layer", "file", F.explode("problems").alias("problem"))


def load(base: DataFrame, fresh: DataFrame, own: DataFrame, named: int = 20) -> DataFrame:
    """A shipped list with downloaded entries over it and people's own ones added.

    base: of `shipped`; fresh, own: of `usable`.  A fresh entry replaces the base's of its id or is added (of several files the last by name stands); own ones are marked
    custom.  An id that then stands twice raises ValueError.
    """
    newest = fresh.groupBy("id").agg(F.max_by(F.struct(*fresh.columns), "file").alias("r")).select("r.*")
    out = base.join(newest.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest).unionByName(own.withColumn("custom", F.lit(True)))
    twice = out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id").limit(named).collect()
    if twice:
        raise ValueError("two entries have the id " + ", ".join(r.id for r in twice))
    return out


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """`calls` of a folder's JSON files; a folder that isn't there holds none."""
    return calls(read_raw(spark, [folder]))


# People


def people(raw: DataFrame) -> DataFrame:
    """Researchers of files (layer, file, content) in the columns of schemas.RESEARCHER, with file and `problems`; the person is the file's name.

    A damaged file is a researcher of whom nothing is known.  Unknown fields and levels are left out.
    """
    rows = _parsed(raw, _PERSON)
    p = lambda c: F.col(f"p.{c}")
    stays = F.coalesce(p("stays"), F.array().cast("array<struct<country:string,start:string,end:string>>"))
    bad = _problems(
        ("not an object", ~F.col("whole")), ("phd_date", _bad_day(p("phd_date"))), ("phd_expected", _bad_day(p("phd_expected"))), ("career_break_months", _given(p("career_break_months")).isNotNull() & _number(p("career_break_months")).isNull()),
        ("nationalities", _bad_codes(p("nationalities"))), ("target_hosts", _bad_codes(p("target_hosts"))), ("stays", F.exists(stays, lambda s: s["country"].isNull() | _bad_day(s["start"]) | _bad_day(s["end"]))),
    )
    told = rows.withColumn("problems", bad).withColumn("ok", F.size("problems") == 0)
    keep = lambda c: F.when(F.col("ok"), c)
    none = F.array().cast("array<string>")
    own = F.transform(stays, lambda s: F.struct(F.upper(s["country"]).alias("country"), day(s["start"]).alias("start"), day(s["end"]).alias("end")))
    return told.select(
        "file", F.regexp_replace("file", r"\.json$", "").alias("person"), keep(day(p("phd_date"))).alias("phd_date"), keep(day(p("phd_expected"))).alias("phd_expected"), keep(F.coalesce(_number(p("career_break_months")), F.lit(0.0))).alias("break_months"),
        keep(F.nullif(_codes(p("nationalities")), none)).alias("nationalities"), keep(_given(F.upper(p("residence")))).alias("residence"), keep(F.when(F.size(own) > 0, own)).alias("stays"), keep(F.filter(F.coalesce(p("fields"), none), lambda f: f.isin(FIELDS))).alias("fields"),
        keep(F.when(p("clinical").isNotNull(), _true(p("clinical")))).alias("clinical"), keep(F.nullif(_codes(p("target_hosts")), none)).alias("targets"), keep(F.when(p("career_level").isin(LEVELS), p("career_level"))).alias("level"), "problems",
    )


# What `sinks.store` writes


def stored(spark: SparkSession, path: str, shape: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a folder of JSON lines in a shape: what `sinks.store` wrote, or a person edited.

    problems has one row (file, lines) for each file with lines that can't be read; the other lines of it are rows.  Fields that the
    shape doesn't have are left out, and missing ones are null.  A folder that isn't there gives no rows.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], shape), spark.createDataFrame([], "file string, lines long")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    read = lines.select("file", F.from_json("value", f"{shape}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    rows = read.where(~broken).select("r.*").drop("_broken")
    return rows, read.where(broken).groupBy("file").agg(F.count("*").alias("lines"))


__all__ = ["RAW", "calls", "damaged", "load", "people", "read_calls", "read_raw", "shipped", "stored", "usable"]
