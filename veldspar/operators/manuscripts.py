"""Manuscript checks: paragraphs to extraction tables to issues.

Paragraphs have doc_id, idx, text, section and is_heading.  Every join and window keeps
doc_id as its key.  Issues are (doc_id, check, severity, code, para_index, detail).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.tables import stored
from veldspar.functions.text import let, matches, scan, sentence_key, sentences, words

from .specs import parse_spec

NOT_BODY = ("references", "back_matter", "acknowledgments")
CALLOUT = r"(?:^|[ (])(?:(?:Supplementary|Extended Data) )?(?:Figures?|Figs?\.|Tables?) S?[0-9]+[A-Za-z]?(?:(?:-|, | and )S?[0-9]+[A-Za-z]?|-[A-Za-z](?![a-z]))*"
LEGEND = r"^(Figure|Fig\.|Table) (S?[0-9]+)\. [A-Z]"
CITATION = r"\[[0-9]{1,3}(?:(?:-|, ?)[0-9]{1,3})*\]"
#: British and American spellings of the same word.
SPELLINGS = [("colour", "color"), ("behaviour", "behavior"), ("tumour", "tumor"), ("labelled", "labeled"), ("analyse", "analyze"), ("centre", "center"), ("fibre", "fiber"), ("grey", "gray")]
UNITS = "mg|kg|ml|mL|nm|mm|cm|kDa|Hz|min"
#: What is looked for in the body, by the name of its column in `read`.
LOOKED_FOR = {
    "callouts": CALLOUT, "citations": CITATION, "uses": r"(?:^|[ ])[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*", "quantities": rf"[0-9](?:\.[0-9]+)? ?(?:{UNITS})(?: |,|\.|;|\)|$)",
    "spellings": "(?i)(?=" + "".join(f"[{''.join(sorted({w[k] for pair in SPELLINGS for w in pair}))}]" for k in (0, 1, 2)) + r")\b(?:" + "|".join(w for pair in SPELLINGS for w in pair) + r")\b", "numerals": r"(?:^|[.!?] )[0-9]+ [a-z]+",
}
HUMAN, ANIMAL = r"(?i)\b(patients?|participants?|volunteers?)\b", r"(?i)\b(mice|mouse|rats?|rabbits?)\b"
ETHICS, CONSENT = r"(?i)(ethics committee|institutional review board)", r"(?i)informed consent"
STATEMENTS = {"data_availability": r"(?i)data availability", "funding": r"(?i)\bfunding\b", "interests": r"(?i)competing interests", "contributions": r"(?i)author contributions"}


def body(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(~F.col("section").isin(*NOT_BODY) & ~F.coalesce("is_heading", F.lit(False)))


def _matched(name: str) -> Column:
    text, rx = F.col("text"), LOOKED_FOR[name]
    return F.when(~F.col("section").isin(*NOT_BODY) & ~F.coalesce("is_heading", F.lit(False)) & text.rlike(rx), matches(text, rx))


def read(paragraphs: DataFrame, names: list[str]) -> DataFrame:
    """Paragraphs with a column for each name: the matches of its pattern, found in one pass and null where there are none."""
    return paragraphs.withColumns({f"_{n}": _matched(n) for n in names})


def look(paragraphs: DataFrame, name: str) -> DataFrame:
    """A row for each match of a pattern in body paragraphs (doc_id, idx, section, start, match), out of the column of `read` where there is one."""
    found = F.col(f"_{name}") if f"_{name}" in paragraphs.columns else _matched(name)
    return paragraphs.select("doc_id", "idx", "section", F.explode(found).alias("m")).select("doc_id", "idx", "section", "m.start", F.col("m.text").alias("match"))


def issue(df: DataFrame, check: str, severity: str, code: str, detail: Column, para: str | None = "idx") -> DataFrame:
    at = F.col(para) if para else F.lit(None)
    return df.select("doc_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), at.cast("int").alias("para_index"), detail.cast("string").alias("detail"))


# Figures and tables


def legends(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, kind, grp, number, idx, n): paragraphs that open as a legend; n counts repeats of a key."""
    rows = paragraphs.where(F.col("text").rlike(LEGEND) & (F.col("section") != "references"))
    label = F.regexp_extract("text", LEGEND, 2)
    out = rows.select("doc_id", "idx", "text", F.when(F.regexp_extract("text", LEGEND, 1) == "Table", "table").otherwise("figure").alias("kind"), F.when(label.startswith("S"), "supplementary").otherwise("main").alias("grp"), F.regexp_replace(label, "S", "").cast("int").alias("number"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "kind", "grp", "number").orderBy("idx")))


def legend_panels(paragraphs: DataFrame) -> DataFrame:
    """Legends with the panels that they label: bracketed letters, of which only the run from A counts."""
    rows = legends(paragraphs).where("n = 1")
    letters = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\(([A-Za-z])\)"), F.lit(1)), F.upper))
    every = F.array(*[F.lit(chr(65 + k)) for k in range(26)])
    # the letters are worked out once, not once for each pair of letters that the run asks about
    run = let(letters, lambda found: F.filter(every, lambda c, k: F.forall(F.slice(every, F.lit(1), k + 1), lambda x: F.array_contains(found, x))))
    return rows.withColumn("panels", run)


def callouts(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, kind, grp, number, panels, short): every item that a callout outside legends names."""
    rows = look(paragraphs.where(~F.col("text").rlike(LEGEND)), "callouts")  # the reference list is no body, so a legend is known by its own text
    each = rows.select("doc_id", "idx", "start", "match", F.explode(parse_spec(F.regexp_extract("match", r"(?:Figures?|Figs?\.|Tables?) (.*)$", 1))).alias("s"))
    extended, supplementary = F.contains("match", F.lit("Extended Data")), F.contains("match", F.lit("Supplementary")) | F.col("s.label").startswith("S")
    return each.select(
        "doc_id", "idx", "start", F.when(F.contains("match", F.lit("Table")), "table").otherwise("figure").alias("kind"), F.when(extended, "extended").when(supplementary, "supplementary").otherwise("main").alias("grp"),
        F.regexp_replace("s.label", "S", "").cast("int").alias("number"), F.col("s.panels").alias("panels"), F.col("match").rlike(r"Figs?\.").alias("short"),
    )


KEY = ["doc_id", "kind", "grp", "number"]


def _first(calls: DataFrame) -> DataFrame:
    return calls.groupBy(*KEY).agg(F.min(F.struct("idx", "start")).alias("at")).select(*KEY, "at.idx", "at.start")


def _label() -> Column:
    return F.concat_ws(" ", "kind", "grp", "number")


def figure_issues(paragraphs: DataFrame, calls: DataFrame | None = None) -> dict[str, DataFrame]:
    """Issues of figures and tables by code.  calls: of `callouts`, where they are at hand."""
    calls = callouts(paragraphs) if calls is None else calls
    held, first = legends(paragraphs), _first(calls)
    keys, groups = held.select(*KEY).distinct(), held.select("doc_id", "kind", "grp").distinct()
    w = Window.partitionBy("doc_id", "kind", "grp").orderBy("number")
    numbered = keys.withColumn("before", F.coalesce(F.lag("number").over(w), F.lit(0))).where("number <> before + 1")
    # late: some smaller cited number is named only later; at one place the smaller stands first, so the least of what follows is it
    later = Window.partitionBy("doc_id", "kind", "grp").orderBy("idx", "start", "number").rowsBetween(1, Window.unboundedFollowing)
    late = first.withColumn("smaller", F.min("number").over(later)).where("smaller < number")
    panels = legend_panels(paragraphs).select(*KEY, "panels", F.col("idx").alias("legend"))
    used = calls.where(F.size("panels") > 0).select(*KEY, "idx", F.explode("panels").alias("panel")).groupBy(*KEY, "panel").agg(F.min("idx").alias("idx"))
    known = used.join(panels.where(F.size("panels") > 0), KEY)
    each = known.groupBy(*KEY, "legend", "panels").agg(F.collect_set("panel").alias("cited"))  # 26 letters at most
    return {
        "duplicate_legend": issue(held.where("n > 1"), "figures", "warning", "duplicate_legend", _label()),
        "no_legend": issue(first.join(groups, ["doc_id", "kind", "grp"], "left_semi").join(keys, KEY, "left_anti"), "figures", "error", "no_legend", _label()),
        "no_legends_at_all": issue(first.where("grp = 'main'").join(groups, ["doc_id", "kind", "grp"], "left_anti").groupBy("doc_id", "kind").agg(F.count("*").alias("n")), "figures", "info", "no_legends_at_all", F.concat_ws(" ", "kind", "n"), None),
        "never_cited": issue(held.where("n = 1").join(first.select(*KEY), KEY, "left_anti"), "figures", "error", "never_cited", _label()),
        "numbering": issue(numbered, "figures", "warning", "numbering", _label(), None),
        "citation_order": issue(late, "figures", "warning", "citation_order", F.concat_ws(" ", "kind", "grp", "number", F.lit("before"), "smaller")),
        "unknown_panel": issue(known.where(~F.array_contains("panels", F.col("panel"))), "figures", "warning", "unknown_panel", F.concat(_label(), "panel")),
        "panels_not_cited": issue(each.where(F.size(F.array_except("panels", "cited")) > 0), "figures", "info", "panels_not_cited", F.concat(_label(), F.lit(" "), F.array_join(F.array_except("panels", "cited"), ",")), "legend"),
        "mixed_names": issue(calls.where("kind = 'figure'").groupBy("doc_id").agg(F.count_if("short").alias("s"), F.count("*").alias("n")).where("s > 0 and s < n"), "figures", "info", "mixed_names", F.concat_ws("/", "s", "n"), None),
    }


# References


def entries(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, place, stated, idx, text, year, doi, key): entries of the reference list; a line without a number of its own continues the one before."""
    rows = paragraphs.where((F.col("section") == "references") & ~F.coalesce("is_heading", F.lit(False)) & (F.trim("text") != ""))
    stated = F.try_to_number(F.regexp_extract("text", r"^\[?([0-9]{1,3})[.\]] ", 1), F.lit("999")).cast("int")
    w = Window.partitionBy("doc_id").orderBy("idx")
    complete = F.lag(F.col("text").rlike(r"(?:18|19|20)[0-9]{2}.*[.)]$")).over(w)
    opens = F.col("stated").isNotNull() | (F.coalesce(complete, F.lit(True)) & ~F.col("text").rlike("^https?://"))
    part = rows.withColumn("stated", stated).withColumn("place", F.sum(opens.cast("int")).over(w))
    whole = part.groupBy("doc_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("idx").alias("idx"), F.min("stated").alias("stated"))
    year = F.nullif(F.regexp_extract("text", "((?:18|19|20)[0-9]{2})", 1), F.lit(""))
    doi = F.nullif(F.rtrim(F.regexp_extract("text", r"(?i)doi:? ?(?:https?://doi.org/)?([^ ]+)", 1), F.lit(".,;")), F.lit(""))
    key = F.left(F.regexp_replace(F.lower(F.regexp_replace("text", r"^\[?[0-9]{1,3}[.\]] ", "")), "[^a-z0-9]", ""), F.lit(90))
    return whole.where(F.length("text") >= 25).withColumns({"year": year, "doi": doi, "key": key, "place": F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))})


def surnames(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.left(c, F.lit(180)), F.lit(r"(?U)\b([A-Z]\w[\w'-]+)\b"), F.lit(1)))


def numeric_citations(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, number): every number in brackets, ranges filled when shorter than 60."""
    rows = look(paragraphs, "citations").select("doc_id", "idx", "start", F.posexplode(F.split(F.regexp_replace("match", r"[\[\] ]", ""), ",")).alias("part", "piece"))
    a, b = F.split_part("piece", F.lit("-"), F.lit(1)).cast("int"), F.nullif(F.split_part("piece", F.lit("-"), F.lit(2)), F.lit("")).cast("int")
    numbers = F.when(b.isNull(), F.array(a)).when((b > a) & (b - a < 60), F.sequence(a, b)).otherwise(F.array(a, b))
    return rows.select("doc_id", "idx", "start", "part", F.explode(numbers).alias("number"))


def name_citations(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, surname, year) of author-year citations in brackets and in running text."""
    inside = scan(body(paragraphs), r"\([^()]*(?:18|19|20)[0-9]{2}[^()]*\)").select("doc_id", "idx", F.explode(F.split(F.regexp_replace("match", "[()]", ""), ";")).alias("piece"))
    running = scan(body(paragraphs), r"[A-Z][A-Za-z-]+(?: et al\.)? \((?:18|19|20)[0-9]{2}\)").select("doc_id", "idx", F.col("match").alias("piece"))
    both = inside.unionByName(running).select("doc_id", "idx", F.regexp_extract("piece", "((?:18|19|20)[0-9]{2})", 1).alias("year"), F.explode(surnames(F.col("piece"))).alias("surname"))
    return both.where("year <> ''").distinct()


def style(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, style): numeric or author_year by the larger count (numeric on a tie), unknown when neither leads."""
    n = numeric_citations(paragraphs).select("doc_id", "idx", "start").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    y = name_citations(paragraphs).select("doc_id", "idx", "year").distinct().groupBy("doc_id").agg(F.count("*").alias("y"))
    both = n.join(y, "doc_id", "full_outer").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0)).alias("y"))
    best, rest = F.greatest("n", "y"), F.least("n", "y")
    return both.select("doc_id", F.when((best < 2 * rest) & (rest > 2), "unknown").when(F.col("n") >= F.col("y"), "numeric").otherwise("author_year").alias("style"))


def reference_issues(paragraphs: DataFrame) -> dict[str, DataFrame]:
    """Issues of the reference list by code."""
    held = entries(paragraphs)
    cited = numeric_citations(paragraphs)
    listed = held.select("doc_id").distinct()
    number = F.coalesce("stated", "place")
    numbers = held.select("doc_id", number.alias("number"), "idx")
    first = cited.groupBy("doc_id", "number").agg(F.min(F.struct("idx", "start", "part", "number")).alias("at")).select("doc_id", "number", "at.idx", "at.start", "at.part")
    order = Window.partitionBy("doc_id").orderBy("idx", "start", "part", "number").rowsBetween(Window.unboundedPreceding, -1)
    late = first.withColumn("before", F.max("number").over(order)).where("number < before")
    w = Window.partitionBy("doc_id").orderBy("place")
    numbered = held.withColumn("before", F.lag("stated").over(w)).where("stated <> before + 1")
    same = held.withColumn("first", F.first("place").over(Window.partitionBy("doc_id", "key").orderBy("place"))).where("place <> first")
    ratio = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("year").isNull()).alias("no_year"), F.count("doi").alias("with_doi"))
    return {
        "no_list": issue(cited.groupBy("doc_id").agg(F.count("*").alias("n")).join(listed, "doc_id", "left_anti"), "references", "info", "no_list", F.col("n"), None),
        "no_reference": issue(first.join(listed, "doc_id", "left_semi").join(numbers, ["doc_id", "number"], "left_anti"), "references", "error", "no_reference", F.col("number")),
        "never_cited": issue(numbers.join(cited.select("doc_id").distinct(), "doc_id", "left_semi").join(first.select("doc_id", "number"), ["doc_id", "number"], "left_anti"), "references", "error", "never_cited", F.col("number")),
        "citation_order": issue(late, "references", "warning", "citation_order", F.concat_ws(" after ", "number", "before")),
        "numbering": issue(numbered, "references", "warning", "numbering", F.col("stated")),
        "duplicate_entry": issue(same, "references", "warning", "duplicate_entry", F.concat_ws("=", "place", "first")),
        "no_year": issue(ratio.where("no_year > 0 and no_year <= greatest(3, 0.2 * n)"), "references", "info", "no_year", F.col("no_year"), None),
        "doi_coverage": issue(ratio.where("with_doi < n and 2 * with_doi >= n"), "references", "info", "doi_coverage", F.concat_ws("/", "with_doi", "n"), None),
        "bad_doi": issue(held.where(F.col("doi").isNotNull() & ~F.col("doi").rlike(r"^10\.[0-9]{4,9}/.+")), "references", "warning", "bad_doi", F.col("doi")),
    }


def name_issues(paragraphs: DataFrame) -> DataFrame:
    """Author-year citations without an entry of that year that shares a surname, and entries that no citation names."""
    held = entries(paragraphs).select("doc_id", "place", "idx", "year", F.explode(surnames(F.col("text"))).alias("surname"))
    cited = name_citations(paragraphs)
    missing = cited.select("doc_id", "idx", "year", "surname").join(held.select("doc_id", "year", "surname"), ["doc_id", "year", "surname"], "left_anti")
    found = cited.join(held.select("doc_id", "year", "surname"), ["doc_id", "year", "surname"], "left_semi").select("doc_id", "idx", "year").distinct()
    lost = missing.join(found, ["doc_id", "idx", "year"], "left_anti")
    unused = held.select("doc_id", "place", "idx").distinct().join(held.join(cited.select("doc_id", "year", "surname"), ["doc_id", "year", "surname"], "left_semi").select("doc_id", "place"), ["doc_id", "place"], "left_anti").join(cited.select("doc_id").distinct(), "doc_id", "left_semi")
    return issue(lost, "references", "error", "name_missing", F.concat_ws(" ", "surname", "year")).unionByName(issue(unused, "references", "error", "name_unused", F.col("place")))


# Abbreviations

#: A bracketed short form and up to eight words before it, both backwards, so that a search begins at brackets alone and not at every word.
BACKWARDS = r"\)([A-Za-z0-9]{1,9}[A-Z])\(((?: [A-Za-z-]+){1,8})"


def definitions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, zone, abbr, expansion): bracketed short forms whose letters begin the words before them."""
    bracketed = body(paragraphs).where(F.col("text").rlike(r" \([A-Z][A-Za-z0-9]{1,9}\)")).withColumn("size", F.length("text"))
    found = bracketed.select("doc_id", "idx", "section", "size", F.explode(matches(F.reverse("text"), BACKWARDS)).alias("m"))
    taken = lambda n: F.reverse(F.regexp_extract("m.text", BACKWARDS, n))
    rows = found.select("doc_id", "idx", "section", (F.col("size") - F.col("m.start") - F.length("m.text")).alias("start"), taken(2).alias("lead"), taken(1).alias("abbr"))
    parts = rows.withColumn("w", F.filter(F.split(F.trim("lead"), "[ -]"), lambda x: x != "")).withColumn("letters", F.regexp_replace(F.upper("abbr"), "[^A-Z]", "")).where("size(w) >= length(letters) and length(letters) > 1")
    last = F.slice("w", F.size("w") - F.length("letters") + 1, F.length("letters"))
    initials = F.array_join(F.transform(last, lambda x: F.upper(F.left(x, F.lit(1)))), "")
    return parts.where(initials == F.col("letters")).select("doc_id", "idx", "start", zone().alias("zone"), "abbr", F.array_join(F.transform(last, F.lower), " ").alias("expansion"))


def zone() -> Column:
    return F.when(F.col("section") == "abstract", "abstract").when(F.col("section") == "methods", "methods").when(F.col("section").isin("introduction", "results", "discussion", "figure_legends"), "main")


def uses(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, abbr): words with two capitals or more that stand outside a definition's brackets."""
    rows = look(paragraphs, "uses").select("doc_id", "idx", "start", F.regexp_replace(F.trim("match"), "s$", "").alias("abbr"))
    return rows.where(F.length("abbr").between(2, 10))


def abbreviation_issues(paragraphs: DataFrame) -> dict[str, DataFrame]:
    """Issues of abbreviations by code."""
    made, used = definitions(paragraphs), uses(paragraphs)
    first = made.groupBy("doc_id", "abbr").agg(F.min(F.struct("idx", "start")).alias("made"))
    early = used.groupBy("doc_id", "abbr").agg(F.min(F.struct("idx", "start")).alias("at"), F.count("*").alias("n"))
    zones = made.where("zone is not null").groupBy("doc_id", "abbr", "zone").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n > 1")
    differ = made.groupBy("doc_id", "abbr").agg(F.array_sort(F.collect_set("expansion")).alias("e")).where("size(e) > 1")
    unknown = early.join(first, ["doc_id", "abbr"], "left_anti").where((F.col("n") >= 3) & F.col("abbr").rlike("^[A-Z]{3,8}$"))
    return {
        "used_before_defined": issue(early.join(first, ["doc_id", "abbr"]).where("at < made").withColumn("idx", F.col("at.idx")), "abbreviations", "warning", "used_before_defined", F.col("abbr")),
        "defined_twice": issue(zones, "abbreviations", "warning", "defined_twice", F.concat_ws(" ", "abbr", "zone", "n")),
        "differing_expansions": issue(differ, "abbreviations", "warning", "differing_expansions", F.concat(F.col("abbr"), F.lit(": "), F.array_join("e", " / ")), None),
        "never_used": issue(made.groupBy("doc_id", "abbr").agg(F.min("idx").alias("idx")).join(early, ["doc_id", "abbr"], "left_anti"), "abbreviations", "info", "never_used", F.col("abbr")),
        "never_defined": issue(unknown.withColumn("idx", F.col("at.idx")), "abbreviations", "info", "never_defined", F.concat_ws(" ", "abbr", "n")),
    }


# Species


def species(paragraphs: DataFrame, genera: list[str]) -> DataFrame:
    """(doc_id, idx, start, genus, epithet, short): binomials of known genera, and their forms with an initial.

    An initial stands for the genus of that letter that the document names first.
    """
    names = "|".join(sorted(genera))
    full = scan(body(paragraphs), rf"\b(?:{names}) [a-z]{{3,}}").select("doc_id", "idx", "start", F.split_part("match", F.lit(" "), F.lit(1)).alias("genus"), F.split_part("match", F.lit(" "), F.lit(2)).alias("epithet"), F.lit(False).alias("short"))
    letter = full.groupBy("doc_id", F.left("genus", F.lit(1)).alias("initial")).agg(F.min_by("genus", F.struct("idx", "start")).alias("genus"))
    brief = scan(body(paragraphs), r"\b[A-Z]\. [a-z]{3,}").select("doc_id", "idx", "start", F.left("match", F.lit(1)).alias("initial"), F.split_part("match", F.lit(" "), F.lit(2)).alias("epithet"))
    known = full.select("doc_id", "genus", "epithet").distinct()
    return full.unionByName(brief.join(letter, ["doc_id", "initial"]).join(known, ["doc_id", "genus", "epithet"], "left_semi").select("doc_id", "idx", "start", "genus", "epithet", F.lit(True).alias("short")))


def species_issues(paragraphs: DataFrame, genera: list[str]) -> dict[str, DataFrame]:
    rows = species(paragraphs, genera).groupBy("doc_id", "genus", "epithet").agg(
        F.min(F.when(F.col("short"), F.struct("idx", "start"))).alias("brief"), F.min(F.when(~F.col("short"), F.struct("idx", "start"))).alias("full"), F.count_if(~F.col("short")).alias("n")
    )
    name = F.concat_ws(" ", "genus", "epithet")
    return {
        "short_before_full": issue(rows.where("brief < full").withColumn("idx", F.col("brief.idx")), "species", "warning", "short_before_full", name),
        "full_again": issue(rows.where("brief is not null and n > 1").withColumn("idx", F.col("full.idx")), "species", "info", "full_again", F.concat_ws(" ", name, "n")),
    }


def italic_share(spans: Column, start: Column, stop: Column) -> Column:
    """How much of a stretch its paragraph's italic spans cover."""
    inside = F.aggregate(spans, F.lit(0), lambda a, s: a + F.greatest(F.lit(0), F.least(s["end"], stop) - F.greatest(s["start"], start)))
    return F.try_divide(inside, stop - start)


# Consistency


def quantities(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, unit, spaced) of every number with a unit."""
    return look(paragraphs, "quantities").select("doc_id", "idx", F.regexp_extract("match", f"({UNITS})[ ,.;)]?$", 1).alias("unit"), F.col("match").rlike("^[0-9.]+ ").alias("spaced"))


def spellings(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, family, british, american): counts of each family's two forms; one pattern finds all, a small map names them."""
    found = look(paragraphs, "spellings").select("doc_id", F.lower("match").alias("word"))
    family = F.create_map(*[F.lit(x) for a, b in SPELLINGS for w in (a, b) for x in (w, a)])[F.col("word")]
    rows = found.select("doc_id", "word", family.alias("family"))
    return rows.groupBy("doc_id", "family").agg(F.count_if(F.col("word") == F.col("family")).alias("british"), F.count_if(F.col("word") != F.col("family")).alias("american"))


def consistency_issues(paragraphs: DataFrame) -> dict[str, DataFrame]:
    units = quantities(paragraphs).groupBy("doc_id", "unit").agg(F.count_if("spaced").alias("s"), F.count_if(~F.col("spaced")).alias("t")).where("s > 0 and t > 0")
    capitals = quantities(paragraphs).groupBy("doc_id", F.lower("unit").alias("u")).agg(F.array_sort(F.collect_set("unit")).alias("forms")).where("size(forms) > 1")
    words_ = spellings(paragraphs)
    whole = words_.groupBy("doc_id").agg(F.sum("british").alias("b"), F.sum("american").alias("a"))
    minority = words_.join(whole, "doc_id").withColumn("odd", F.when(F.col("b") >= F.col("a"), F.col("american")).otherwise(F.col("british"))).where("odd > 0 and a > 0 and b > 0")
    numeral = look(paragraphs.where("section <> 'figure_legends'"), "numerals")
    micro = body(paragraphs).groupBy("doc_id").agg(F.bool_or(F.contains("text", F.lit("µ"))).alias("sign"), F.bool_or(F.contains("text", F.lit("μ"))).alias("letter"))
    return {
        "unit_spacing": issue(units, "consistency", "warning", "unit_spacing", F.concat_ws(" ", "unit", F.when(F.col("s") >= F.col("t"), "tight").otherwise("spaced"), F.least("s", "t")), None),
        "unit_capitals": issue(capitals, "consistency", "warning", "unit_capitals", F.array_join("forms", "/"), None),
        "spelling": issue(minority, "consistency", "warning", "spelling", F.concat_ws(" ", "family", "odd"), None),
        "numeral_start": issue(numeral.withColumn("n", F.regexp_extract("match", "([0-9]+)", 1)), "consistency", "info", "numeral_start", F.col("n")),
        "two_micro_signs": issue(micro.where("sign and letter"), "consistency", "info", "two_micro_signs", F.lit("micro"), None),
    }


# Statements and sizes


def statements(paragraphs: DataFrame) -> DataFrame:
    """One row a document: how often it names humans and animals, and which statements it makes."""
    text = F.col("text")
    flags = {k: F.bool_or(text.rlike(rx)) for k, rx in STATEMENTS.items()}
    return paragraphs.where("section <> 'references'").groupBy("doc_id").agg(F.sum(F.regexp_count(text, F.lit(HUMAN))).alias("humans"), F.sum(F.regexp_count(text, F.lit(ANIMAL))).alias("animals"), F.bool_or(text.rlike(ETHICS)).alias("ethics"), F.bool_or(text.rlike(CONSENT)).alias("consent"), *[c.alias(k) for k, c in flags.items()])


def statement_issues(paragraphs: DataFrame, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Issues of statements by code.  rows: of `statements`, where they are at hand."""
    rows = statements(paragraphs) if rows is None else rows
    absent = F.array_join(F.filter(F.array(*[F.when(~F.col(k), F.lit(k)) for k in STATEMENTS]), lambda x: x.isNotNull()), ",")
    return {
        "human_ethics": issue(rows.where("humans >= 2 and not ethics"), "statements", "warning", "human_ethics", F.col("humans"), None),
        "human_consent": issue(rows.where("humans >= 2 and not consent"), "statements", "warning", "human_consent", F.col("humans"), None),
        "animal_ethics": issue(rows.where("animals >= 2 and not ethics"), "statements", "warning", "animal_ethics", F.col("animals"), None),
        "missing_statements": issue(rows.where(absent != ""), "statements", "info", "missing_statements", absent, None),
    }


def sizes(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, words, abstract_words, main_words, figures, tables, entries): one row a document."""
    n = words(F.col("text"))
    per = lambda *s: F.sum(F.when(F.col("section").isin(*s) & ~F.col("is_heading"), n).otherwise(0))
    base = paragraphs.groupBy("doc_id").agg(F.sum(F.when(F.col("section") != "references", n).otherwise(0)).alias("words"), per("abstract").alias("abstract_words"), per("introduction", "methods", "results", "discussion").alias("main_words"))
    held = legends(paragraphs).where("n = 1 and grp = 'main'").groupBy("doc_id").agg(F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"))
    refs = entries(paragraphs).groupBy("doc_id").agg(F.count("*").alias("entries"))
    return base.join(held, "doc_id", "left").join(refs, "doc_id", "left").na.fill(0, ["figures", "tables", "entries"])


def limit_issues(paragraphs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Measures above their limit (warning) or at 95% of it (info)."""
    rows = sizes(paragraphs).unpivot("doc_id", list(limits), "measure", "value")
    known = F.broadcast(paragraphs.sparkSession.createDataFrame(list(limits.items()), "measure string, most int"))
    over = rows.join(known, "measure")
    return issue(over.where("value > most"), "submission", "warning", "over_limit", F.concat_ws(" ", "measure", "value"), None).unionByName(issue(over.where("value <= most and value >= 0.95 * most"), "submission", "info", "near_limit", F.concat_ws(" ", "measure", "value"), None))


def crossing(paragraphs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, idx, before): the paragraph with the first word over a limit, and the words before it."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = body(paragraphs).where("section <> 'figure_legends'").withColumn("n", words(F.col("text"))).withColumn("total", F.sum("n").over(w))
    return rows.where((F.col("total") > limit) & (F.col("total") - F.col("n") <= limit)).select("doc_id", "idx", (F.col("total") - F.col("n")).alias("before"))


def missing_sections(paragraphs: DataFrame, required: list[str]) -> DataFrame:
    """Required sections that no paragraph of a document belongs to."""
    names = F.broadcast(paragraphs.sparkSession.createDataFrame([(r,) for r in required], "section string"))  # a short list
    want = paragraphs.select("doc_id").distinct().crossJoin(names)
    return issue(want.join(paragraphs.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti"), "submission", "warning", "missing_section", F.col("section"), None)


# Versions


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in computes."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def changes(old: DataFrame, new: DataFrame, least: float = 0.55) -> DataFrame:
    """(doc_id, idx, sentence, kind, similarity): sentences of a revision that the old text lacks, edited or added.

    Exact keys go first; the rest are compared with the same document's dropped sentences of a
    length that can reach `least` at all.
    """
    split = lambda df: df.where(~F.coalesce("is_heading", F.lit(False))).select("doc_id", "idx", F.posexplode(sentences(F.col("text"))).alias("at", "sentence")).withColumn("key", sentence_key(F.col("sentence"))).where("key <> ''")
    no = lambda kind: F.lit(None).cast(kind)
    a = split(old).select("doc_id", "key", no("int").alias("idx"), no("string").alias("sentence"))
    # each side is split once; a sentence's key meets both sides in one grouping inside its document
    per = a.unionByName(split(new).select("doc_id", "key", F.col("idx").cast("int").alias("idx"), "sentence")).repartition("doc_id").groupBy("doc_id", "key").agg(
        F.bool_or(F.col("sentence").isNull()).alias("old"), F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("idx", "sentence"))).alias("where")  # of one sentence in one document
    )
    here, there = F.col("old") & (F.size("where") == 0), ~F.col("old")
    sides = per.where(here | there).groupBy("doc_id").agg(F.collect_list(F.when(there, F.struct("key", "where"))).alias("fresh"), F.collect_list(F.when(here, F.col("key"))).alias("gone"))
    short, both = lambda x, w: F.least(F.length(x), F.length(w)), lambda x, w: F.length(x) + F.length(w)
    each = sides.select("doc_id", F.explode("fresh").alias("f"), "gone").select("doc_id", "f.key", "f.where", F.explode_outer(F.filter("gone", lambda w: 2 * short(F.col("f.key"), w) / both(F.col("f.key"), w) >= least)).alias("was"))
    scored = each.withColumn("ratio", similarity(F.col("key"), F.coalesce("was", F.lit("")))).groupBy("doc_id", "key").agg(F.max(F.when(F.col("was").isNotNull(), F.col("ratio"))).alias("ratio"), F.first("where").alias("where"))
    edited = F.coalesce(F.col("ratio") >= least, F.lit(False))
    return scored.select("doc_id", F.explode("where").alias("w"), F.when(edited, "edited").otherwise("added").alias("kind"), F.round(F.when(edited, F.col("ratio")), 6).alias("similarity")).select("doc_id", "w.idx", "w.sentence", "kind", "similarity")


#: Checks in their fixed order.
CHECKS = {"figures": figure_issues, "references": reference_issues, "abbreviations": abbreviation_issues, "consistency": consistency_issues, "statements": statement_issues}
#: What each check reads out of `read`.
READ = {"figures": ["callouts"], "references": ["citations"], "abbreviations": ["uses"], "consistency": ["quantities", "spellings", "numerals"], "statements": []}


def run(paragraphs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Issues of all checks, or of some, with the check's place.

    Each text is made and searched once: the paragraphs are stored with what the checks look for, and callouts and statements, which many issues share, as tables of their own.
    """
    names = [n for n in CHECKS if not only or n in only]
    texts = stored(read(paragraphs, [m for n in names for m in READ[n]]), "paragraphs")
    shared = {"figures": callouts, "statements": statements}
    out = None
    for k, (name, check) in enumerate(CHECKS.items()):
        if name not in names:
            continue
        more = [stored(shared[name](texts), name)] if name in shared else []
        for df in check(texts, *more).values():
            df = df.withColumn("check_rank", F.lit(k))
            out = df if out is None else out.unionByName(df)
    return out
