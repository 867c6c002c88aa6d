"""Text functions on columns: matches with offsets, sections, words and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heading words and the section they open.
SECTIONS = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "introduction", "methods": "methods", "materials and methods": "methods", "data availability": "methods", "results": "results", "discussion": "discussion",
    "conclusion": "discussion", "conclusions": "discussion", "references": "references", "bibliography": "references", "figure legends": "figure_legends", "supplementary tables": "figure_legends", "acknowledgments": "acknowledgments", "acknowledgements": "acknowledgments",
}
WORD = r"(?U)\w[\w'’-]*"


def words(c: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def spans(c: Column, pattern: str) -> Column:
    """array<struct<start, text, before>> of every match: its character offset from 0, its text and the text since the match before.

    The pattern runs twice over the text and no more, also inside other array functions.
    """

    def placed(s):
        both = F.zip_with(s["gaps"], s["found"], lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        ends = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at"), F.concat(a["out"], F.array(a["at"] + x["g"])).alias("out")))["out"]
        return F.filter(F.transform(F.arrays_zip(s["found"].alias("t"), ends.alias("at"), s["gaps"].alias("g")), lambda x: F.struct(x["at"].alias("start"), x["t"].alias("text"), x["g"].alias("before"))), lambda m: m["text"].isNotNull())

    return let(F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern, -1).alias("gaps")), placed)


def pieces(c: Column, pattern: str) -> Column:
    """A text's pieces, a gap and a match in turn, with a gap first and last; the pattern runs once over the text.

    Matches are marked with U+0001 and the text is cut there, so the text must be `unmarked`.
    """
    return F.split(F.regexp_replace(c, pattern, "\x01$0\x01"), "\x01", -1)


def unmarked(c: Column) -> Column:
    """A text with U+0002 for U+0001: as long, and the same to patterns that name neither."""
    return F.replace(c, F.lit("\x01"), F.lit("\x02"))


def places(parts: Column, run: int = 64) -> Column:
    """array<int>: the character offset of each piece. Offsets are gathered in runs, so that a long list isn't copied for each of them."""
    none = F.array().cast("array<int>")
    piece = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    cut = lambda k: F.slice(parts, k * run + 1, F.lit(run))

    def add(a, k):
        return let(F.aggregate(cut(k), F.struct(a["at"].alias("at"), none.alias("out")), piece), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

    one = lambda: F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), piece)["out"]
    many = lambda: F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / run).cast("int")), F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), add)["out"])
    return F.when(F.size(parts) <= run, one()).otherwise(many())


def matches(c: Column, pattern: str) -> Column:
    """array<struct<start, text>> of every match of a pattern, with character offsets from 0."""
    return F.transform(spans(c, pattern), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text")))


def scan(paragraphs: DataFrame, pattern: str) -> DataFrame:
    """A row for each match: the paragraph's doc_id, idx and section, and start and text of the match."""
    return paragraphs.where(F.col("text").rlike(pattern)).select("doc_id", "idx", "section", F.explode(matches(F.col("text"), pattern)).alias("m")).select("doc_id", "idx", "section", "m.start", F.col("m.text").alias("match"))


def with_sections(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, idx, text, style) with is_heading and the section carried forward from the last heading."""
    known = F.create_map(*[F.lit(x) for p in SECTIONS.items() for x in p])
    bare = F.regexp_replace(F.lower(F.trim("text")), r"^[0-9]+[.)]?\s+|\s*:$", "")
    styled = F.col("style").rlike("^(Heading|Title)") & (F.length("text") < 120)
    own = F.coalesce(F.try_element_at(known, bare), F.when(styled, bare))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("own", own)
    return out.withColumn("is_heading", F.col("own").isNotNull()).withColumn("section", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("front_matter"))).drop("own")


def sentences(c: Column) -> Column:
    """Sentences of a text; a full stop after a short abbreviation or an initial ends none."""
    return F.filter(F.split(c, r"(?<!\b(?:al|Fig|Figs|vs|cf|no|[A-Z])\.)(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda s: F.trim(s) != "")


def sentence_key(c: Column) -> Column:
    """Lower-case words of a sentence with its numbers masked."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(c), r"[0-9]+(?:[.,][0-9]+)*", "0"), F.lit(r"(?U)(\w+)"), F.lit(1)), " ")
