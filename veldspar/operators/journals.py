"""Journal rules as data: layered profiles and the checks that only a journal asks for.

A profile is a JSON object in a file; folders lie over one another, and of files with one name the first folder's that can be used stands.
Documents name their journal's file, so rules are joined to findings by that name, and nothing here grows with the number of journals on one machine.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manuscripts import issue

CHECK = "submission"
RAW = "layer int, file string, content string"
_FIELDS = (
    "name string, limits map<string,string>, required_sections array<string>, abstract_headings array<string>, reference_style string, max_authors_listed string, require_doi string, template string, "
    "publisher string, article_type string, guidelines_url string, verified string, notes string, _broken string"
)
#: Days of a month, months after which a profile is worth a look, and after which it may be out of date.
MONTH, OLD, STALE = 30.44, 6, 12
#: How many entries an issue lists.
LISTED = 12


def read_raw(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(layer, file, content) of the JSON files in folders, the first folder over the others; a folder that isn't there holds none."""
    jvm, out = spark.sparkContext._jvm, spark.createDataFrame([], RAW)
    for k, folder in enumerate(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
            out = out.unionByName(files.select(F.lit(k).alias("layer"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")))
    return out


def parsed(raw: DataFrame) -> DataFrame:
    """Profiles with `problems`, an array of what is wrong with each; empty where it can be used.

    raw: (layer, file, content).  A file must hold a JSON object; reference_style is numbered, author_year or nothing; verified is a date of
    the form 2026-01-31 or nothing; limits and max_authors_listed are whole numbers.  A profile without a name has
    its file's.  Empty texts count as nothing, 0 and false as false.
    """
    p = F.from_json("content", _FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = raw.select("layer", "file", p.alias("p"), F.coalesce(F.col("content"), F.lit("")).alias("content"))
    said = lambda c: F.nullif(F.trim(F.col(f"p.{c}")), F.lit(""))
    truthy = lambda c: F.coalesce(~F.lower(F.col(f"p.{c}")).isin("", "false", "0", "null"), F.lit(False))
    style, verified, most = F.lower(said("reference_style")), said("verified"), F.nullif(said("max_authors_listed"), F.lit("0"))
    day = F.when(verified.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(verified, "yyyy-MM-dd"))
    whole = lambda v: v.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$")
    limits = F.coalesce("p.limits", F.create_map().cast("map<string,string>"))
    bad = F.array_compact(
        F.array(
            F.when(F.col("p").isNull() | F.col("p._broken").isNotNull() | ~F.col("content").rlike(r"^\s*\{"), "not an object"),
            F.when(~style.isin("numbered", "author_year"), "reference_style"),
            F.when(verified.isNotNull() & day.isNull(), "verified"),
            F.when(~F.forall(F.map_values(limits), lambda v: F.coalesce(whole(v), F.lit(False))), "limits"),
            F.when(~whole(most), "max_authors_listed"),
        )
    )
    lists = lambda c: F.coalesce(F.col(f"p.{c}"), F.array().cast("array<string>")).alias(c)
    return rows.select(
        "layer", "file", F.coalesce(said("name"), F.regexp_replace("file", r"\.json$", "")).alias("name"), F.transform_values(limits, lambda k, v: F.trim(v).try_cast("int")).alias("limits"), lists("required_sections"), lists("abstract_headings"),
        style.alias("reference_style"), most.try_cast("int").alias("max_authors_listed"), truthy("require_doi").alias("require_doi"), truthy("template").alias("template"), said("publisher").alias("publisher"),
        said("article_type").alias("article_type"), said("guidelines_url").alias("guidelines_url"), day.alias("verified"), said("notes").alias("notes"), bad.alias("problems"),
    )


def overlay(profiles: DataFrame, templates: bool = False) -> DataFrame:
    """One profile for each file name: of those without problems (and, unless asked for, no templates) the one of the first layer.

    What can't be used hides nothing below it.  Of one layer's repeated rows the least content's stands, told by its fields.
    """
    usable = profiles.where((F.size("problems") == 0) & (F.lit(templates) | ~F.col("template")))
    fields = [c for c in usable.columns if c not in ("layer", "file", "limits", "problems")]
    best = Window.partitionBy("file").orderBy("layer", *fields, F.array_sort(F.map_entries("limits")))
    return usable.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "problems")


def months_old(verified: Column, today: date) -> Column:
    return F.datediff(F.lit(today), verified) / F.lit(MONTH).cast("double")


def assigned(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """documents (doc_id, file) with the profile of their journal; a document whose journal has none gets no row."""
    return documents.where("doc_id is not null").select("doc_id", "file").distinct().join(profiles, "file")


def provenance(rules: DataFrame, today: date) -> DataFrame:
    """Which profile a document was held against, and how far it can be trusted.

    rules: of `assigned`.  An unverified profile and one verified over STALE months ago are warnings, one over OLD months an info.  A
    profile's notes are an info, unless they say of an unverified one that it was filled in beforehand.
    """
    age = months_old(F.col("verified"), today)
    label = F.concat_ws(" · ", "name", "article_type")
    months = F.concat_ws(" ", "name", F.floor(age).cast("string"))
    noted = F.col("notes").isNotNull() & ~(F.col("verified").isNull() & F.startswith("notes", F.lit("Pre-filled")))
    out = issue(rules, CHECK, "info", "checked_against", F.concat_ws("; ", label, F.col("verified").cast("string"), "guidelines_url"), None)
    for severity, code, when, detail in (
        ("warning", "unverified", F.col("verified").isNull(), F.col("name")), ("warning", "out_of_date", age > STALE, months), ("info", "worth_confirming", (age > OLD) & (age <= STALE), months), ("info", "notes", noted, F.col("notes")),
    ):
        out = out.unionByName(issue(rules.where(when), CHECK, severity, code, detail, None))
    return out


def _severity(rules: DataFrame, code: str, detail: Column, para: str | None) -> DataFrame:
    """Errors where the profile was verified, warnings where it wasn't."""
    made = [issue(rules.where(when), CHECK, severity, code, detail, para) for severity, when in (("error", "verified is not null"), ("warning", "verified is null"))]
    return made[0].unionByName(made[1])


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def abstract_headings(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents whose abstract lacks headings that the journal asks for: a heading opens the abstract, a line or a sentence, and ends in a mark.

    One issue for each document, at the abstract's first paragraph; a document without an abstract has none.
    """
    rows = paragraphs.where("section = 'abstract' and text <> ''").select("doc_id", "idx", "text")
    wanting = rules.where(F.size("abstract_headings") > 0).select("doc_id", "name", "verified", "abstract_headings")
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"))
    held = texts.select("doc_id", F.get("p", 0)["idx"].alias("idx"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")).join(wanting, "doc_id")
    there = lambda h: F.rlike(F.col("text"), F.concat(F.lit(r"(?i)(?:^|\n|\.\s)\s*"), _quoted(h), F.lit("\\s*[:.–—\n-]")))
    lacking = held.withColumn("lacking", F.filter("abstract_headings", lambda h: ~there(h))).where(F.size("lacking") > 0)
    return _severity(lacking, "abstract_headings", F.array_join("lacking", ", "), "idx")


def _words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.trim(c)), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'’-]*"), F.lit(0)), lambda w: ~w.isin("and", "of", "the"))


def required_sections(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Sections that the journal requires and a document lacks.

    A section is there by its name, or where a heading, or the first 70 characters of a paragraph, holds the words of the requirement in
    order (and, of, the aside).  One issue for each requirement.
    """
    wanted = rules.where(F.size("required_sections") > 0).select("doc_id", "name", "verified", F.array_distinct("required_sections").alias("wanted"))
    said = F.lower(F.when(F.coalesce("is_heading", F.lit(False)), F.col("text")).otherwise(F.left("text", F.lit(70))))
    rows = paragraphs.where("text <> ''").select("doc_id", "section", said.alias("said")).join(wanted.select("doc_id", "wanted"), "doc_id")
    pattern = lambda r: F.concat(F.lit("(?s)"), F.array_join(F.transform(_words(r), _quoted), ".*"))
    found = F.filter("wanted", lambda r: (F.col("section") == F.replace(F.lower(F.trim(r)), F.lit(" "), F.lit("_"))) | F.rlike(F.col("said"), pattern(r)))
    there = rows.select("doc_id", F.explode(found).alias("required")).distinct()
    each = wanted.select("doc_id", "verified", F.explode("wanted").alias("required"))
    return _severity(each.join(there, ["doc_id", "required"], "left_anti"), "required_section", F.col("required"), None)


def reference_issues(held: DataFrame, rules: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """What a journal asks of a reference list: its style of citation, how many authors an entry prints, and a DOI for each.

    held: of `citations.listed`; rules: of `assigned`; styles: of `citations.styles`, where the style is to be judged.  Keys and notes count as names, and an unknown style
    is none.  One issue for each rule of a document; the first LISTED places are named and the others counted.
    """
    asked = rules.select("doc_id", "reference_style", "max_authors_listed", "require_doi")
    wanted = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("place", "idx"))))
    per = held.select("doc_id", "place", "idx", "author_count", "doi").join(asked, "doc_id").groupBy(*asked.columns).agg(
        F.min("idx").alias("idx"), wanted(F.col("author_count") > F.col("max_authors_listed")).alias("over"), wanted(F.col("require_doi") & F.col("doi").isNull()).alias("bare")  # of one list
    )
    if styles is None:
        per = per.withColumn("used", F.lit(None).cast("string"))
    else:
        used = F.when(F.col("style") == "numeric", "numbered").when(F.col("style") != "unknown", "author_year")
        per = per.join(styles.select("doc_id", used.alias("used")), "doc_id", "left")

    def places(c):
        more = F.when(F.size(c) > LISTED, F.concat(F.lit(" and "), F.size(c) - LISTED, F.lit(" more"))).otherwise("")
        return F.concat(F.array_join(F.transform(F.slice(c, 1, LISTED), lambda x: x["place"].cast("string")), ", "), more)

    made = lambda code, when, idx, detail: F.when(when, F.struct(F.lit(code).alias("code"), idx.alias("idx"), detail.alias("detail")))
    first = lambda c: F.get(F.col(c), 0)["idx"]
    listed = F.array_compact(
        F.array(
            made("journal_style", F.col("used") != F.col("reference_style"), F.col("idx"), F.concat_ws(" instead of ", "used", "reference_style")),
            made("too_many_authors", F.size("over") > 0, first("over"), F.concat(F.col("max_authors_listed").cast("string"), F.lit(": "), places(F.col("over")))),
            made("doi_required", F.size("bare") > 0, first("bare"), F.concat(F.lit("none: "), places(F.col("bare")))),
        )
    )
    rows = per.select("doc_id", F.explode(listed).alias("i")).select("doc_id", "i.*")
    return rows.select("doc_id", F.lit("references").alias("check"), F.lit("warning").alias("severity"), "code", F.col("idx").cast("int").alias("para_index"), "detail")
