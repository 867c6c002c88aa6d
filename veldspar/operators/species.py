"""Species names that a manuscript itself gives away, and how it writes them.

A capitalised word before a lower-case one is a candidate; the document's own evidence decides which are names: one in
italics, one that is also written with an initial, or a genus that stands before sp. or spp. elsewhere.  No list of genera is needed.
Paragraphs have doc_id, idx, text, section and is_heading, and italic_spans where known; every join has doc_id in its key.
The lists of words that are no names are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import spans

CHECK = "species"
SECTIONS = "abstract introduction methods results discussion conclusions supplementary figure_legends".split()
# How a name in full, with an initial and before sp. looks.  The capital comes before the look behind it, which few places then need.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.])", r"(?![\p{L}\p{N}_-])"
_CAPITAL = r"[A-Z](?<![\p{L}\p{N}_.][A-Z])"
FULL = rf"{_CAPITAL}[a-z]{{3,}}+\s++[a-z]{{3,}}+{_AFTER}"
BRIEF = rf"{_CAPITAL}\.\s*+[a-z]{{3,}}+{_AFTER}"
UNNAMED = rf"{_CAPITAL}[a-z]{{3,}}+\s++spp?\."
#: Endings of ranks above the genus.
HIGHER = r"(?:aceae|ales|idae|inae|oidea|mycetes|mycota|viridae)$"
NO_GENUS = (
    "This That These Those There Their They Then Thus When Where While Which With After Before Both Each Here However Although Because Since Therefore Finally First Second Third Next Among Between During "
    "Table Figure Data Methods Results Discussion Introduction Abstract Supplementary Materials Author Authors Funding Ethics Sample Samples Total Mean Median Type Cell Cells Mouse Mice Human Gene Genes Protein Proteins Some Most Using Based Given"
).split()
NO_EPITHET = "and the for with from were was are has had not but all may can did does into than that this these those which who how why when where used using shown showed found data levels samples cells spp".split()


def body(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(F.col("section").isin(SECTIONS) & ~F.coalesce("is_heading", F.lit(False)) & (F.col("text") != ""))


def _italic(spans: Column, m: Column) -> Column:
    """Whether spans cover more than six tenths of a match."""
    stop = m["start"] + F.length(m["text"])
    inside = F.aggregate(spans, F.lit(0), lambda a, s: a + F.greatest(F.lit(0), F.least(s["end"], stop) - F.greatest(s["start"], m["start"])))
    return F.lit(10) * inside > F.lit(6) * F.length(m["text"])


def read(paragraphs: DataFrame, no_genus: Iterable[str] = tuple(NO_GENUS), no_epithet: Iterable[str] = tuple(NO_EPITHET)) -> DataFrame:
    """(doc_id, idx, kind, start, said, italic, initial, genus, epithet): what may be names, in one pass over the paragraphs.

    Kind f is a full name, b one with an initial (its genus is null), u a genus before sp. or spp. (its epithet is that form).  Words that are no names and ranks above
    the genus are left out of f.
    """
    text, no = F.col("text"), F.lit(None).cast("string")
    rows = body(paragraphs).where(text.rlike(rf"{_CAPITAL}(?:[a-z]{{3,}}+\s++[a-z]|\.\s*+[a-z]{{3}})"))
    italic = lambda m: F.lit(False)
    if "italic_spans" in paragraphs.columns:
        rows = rows.withColumn("italic_spans", F.coalesce("italic_spans", F.array().cast(paragraphs.schema["italic_spans"].dataType)))
        italic = lambda m: _italic(F.col("italic_spans"), m)

    def event(kind, genus, epithet):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["text"].alias("said"), italic(m).alias("italic"), F.left(m["text"], F.lit(1)).alias("initial"), genus(m["text"]).alias("genus"), epithet(m["text"]).alias("epithet"))

    first, last = (lambda t: F.regexp_extract(t, r"^(\S+)", 1)), (lambda t: F.regexp_extract(t, r"(\S+)$", 1))
    full = F.filter(F.transform(spans(text, FULL), event("f", first, last)), lambda e: ~e["genus"].isin(list(no_genus)) & ~e["epithet"].isin(list(no_epithet)) & ~e["genus"].rlike(HIGHER))
    brief = F.transform(spans(text, BRIEF), event("b", lambda t: no, lambda t: F.regexp_extract(t, "([a-z]+)$", 1)))
    unnamed = F.filter(F.transform(spans(text, UNNAMED), event("u", first, last)), lambda e: ~e["genus"].isin(list(no_genus)))
    return rows.select("doc_id", "idx", F.explode(F.concat(full, brief, unnamed)).alias("e")).select("doc_id", "idx", "e.*")


def _known(events: DataFrame) -> DataFrame:
    """The events with the genus that an initial stands for, and `kept`, whether they mention a name with evidence; all windows lie within a document."""
    of = lambda kind: F.col("kind") == kind
    at = F.struct("idx", "start", "genus")
    first = F.min(F.when(of("f"), at)).over(Window.partitionBy("doc_id", "initial"))
    named = events.repartition("doc_id").withColumn("genus", F.when(of("b"), first["genus"]).otherwise(F.col("genus"))).where("genus is not null")
    name, genus = Window.partitionBy("doc_id", "genus", "epithet"), Window.partitionBy("doc_id", "genus")
    evidence = F.max(of("b") | (of("f") & F.col("italic"))).over(name) | F.max(of("u")).over(genus)
    return named.withColumn("kept", ~of("u") & F.max(of("f")).over(name) & evidence)


def mentions(events: DataFrame) -> DataFrame:
    """(doc_id, genus, epithet, idx, start, said, italic, brief) of the names with evidence, in full and with an initial.

    events: of `read`.  An initial stands for the genus of that letter that the document names first; one whose full name it never gives is left out.
    """
    return _known(events).where("kept").select("doc_id", "genus", "epithet", "idx", "start", "said", "italic", (F.col("kind") == "b").alias("brief"))


def _names(events: DataFrame) -> DataFrame:
    """One row for each name of a document, and for each genus before sp. or spp. (its epithet is null)."""
    known = _known(events).withColumn("form", F.when(F.col("kind") == "u", F.col("epithet"))).withColumn("epithet", F.when(F.col("kind") != "u", F.col("epithet")))
    of, at = lambda kind: F.col("kind") == kind, F.struct("idx", "start")
    return known.where("kept or kind = 'u'").groupBy("doc_id", "genus", "epithet").agg(
        F.count("*").alias("n"), F.count_if("italic").alias("n_italic"), F.min(F.when(~F.col("italic"), F.col("idx"))).alias("plain"), F.min(F.struct("idx", "start", of("b").alias("brief"))).alias("first"), F.count_if(of("f")).alias("n_full"),
        F.array_sort(F.collect_list(F.when(of("f"), at))).alias("full"), F.count_if(F.col("form") == "sp.").alias("one"), F.count_if(F.col("form") == "spp.").alias("more"),  # of one name in one document
    )


def _lower_case(paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, genus, epithet, idx): the first paragraph that writes a known name's genus small, not at the start of a sentence.

    A document's names go to its paragraphs as patterns; a paragraph is judged by its first such place.
    """
    pattern = F.concat(F.lit(rf"{_BEFORE}"), F.lower("genus"), F.lit(r"\s+"), F.col("epithet"), F.lit(_AFTER))
    held = names.groupBy("doc_id").agg(F.collect_list(F.struct("genus", "epithet", pattern.alias("rx"))).alias("names"))  # the names of one document
    # few paragraphs hold a genus in small letters at all, and a pattern from a row is compiled for it
    rows = body(paragraphs).select("doc_id", "idx", "text").join(held.withColumnRenamed("doc_id", "_of"), F.col("doc_id").eqNullSafe(F.col("_of"))).where(F.exists("names", lambda n: F.contains(F.col("text"), F.lower(n["genus"]))))
    inside = lambda n: F.contains(F.col("text"), F.lower(n["genus"])) & F.rlike(F.col("text"), n["rx"]) & ~F.rtrim(F.left(F.col("text"), F.regexp_instr(F.col("text"), n["rx"]) - 1)).rlike(r"[.!?]$")
    return rows.select("doc_id", "idx", F.explode(F.filter("names", inside)).alias("n")).groupBy("doc_id", "n.genus", "n.epithet").agg(F.min("idx").alias("idx"))


def issues(paragraphs: DataFrame, events: DataFrame) -> DataFrame:
    """Issues of species names.  events: of `read` over the paragraphs."""
    label = F.concat_ws(" ", "genus", "epithet")
    made = lambda code, severity, when, idx, detail: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), idx.alias("idx"), detail.alias("detail")))
    named, plain = F.col("epithet").isNotNull(), F.col("plain")
    shaped = named & (F.col("n") >= 2) & plain.isNotNull()
    listed = F.array_compact(
        F.array(
            made("mixed_italics", "warning", shaped & (F.col("n_italic") > 0), plain, F.concat_ws(" ", label, "n_italic", F.col("n") - F.col("n_italic"))), made("never_italic", "warning", shaped & (F.col("n_italic") == 0), plain, label),
            made("short_before_full", "warning", named & F.col("first.brief"), F.col("first.idx"), label),
            made("full_again", "info", named & ~F.col("first.brief") & (F.col("n_full") > 1) & (F.col("n_full") < F.col("n")), F.get("full", 1)["idx"], F.concat_ws(" ", label, F.col("n_full") - 1)),
            made("sp_and_spp", "info", ~named & (F.col("one") > 0) & (F.col("more") > 0), F.col("first.idx"), F.col("genus")),
        )
    )
    names = _names(events)
    rows = names.select("doc_id", F.explode(listed).alias("i")).select("doc_id", "i.*")
    known = names.where("epithet is not null").select("doc_id", "genus", "epithet")
    small = _lower_case(paragraphs, known).select("doc_id", F.lit("warning").alias("severity"), F.lit("lower_case_genus").alias("code"), "idx", label.alias("detail"))
    return rows.unionByName(small).select("doc_id", F.lit(CHECK).alias("check"), "severity", "code", F.col("idx").cast("int").alias("para_index"), "detail")
