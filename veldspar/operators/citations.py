"""Citations of a manuscript and its reference list, matched by number, by name, by key and by note.

Paragraphs have doc_id, idx, text, section and is_heading; superscript_spans and footnote_ids are read
where they exist.  A citation may begin in one paragraph and end in the next (files made from pages hold a
paragraph for each line), so keys and names are searched in a document's joined body; a match is taken back to its
paragraph by one sorted pass over matches and paragraph starts.  Every join, window and group has doc_id in its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import let

from .manuscripts import body, entries, issue

CHECK = "references"
# What a year, a surname, a key and an author are, and capitalised words that are no surnames.
YEAR = r"(?<![\p{L}\p{N}_])((?:18|19|20)[0-9]{2})[a-z]?(?![\p{L}\p{N}_])"
SURNAME = r"(?<![\p{L}\p{N}_])([A-Z][A-Za-zÀ-ɏ'’-]{1,25})"
NO_SURNAMES = "Fig Figure Figures Table Tables Supplementary See Data Extended Ref Refs Eq Equation Chapter Section In The And Panel Movie Video Appendix Note".split()
_KEY = r"[A-Za-z][A-Za-z0-9+'’-]{1,19}"
KEYS = rf"\[{_KEY}(?:\s*[,;]\s*{_KEY})*\]"
_DATED = r"{0,200}?(?<![\p{L}\p{N}_])(?:18|19|20)[0-9]{2}[a-z]?(?![\p{L}\p{N}_])"
ROUND, SQUARE = rf"\([^()]{_DATED}[^()]{{0,40}}\)", rf"\[[^\[\]]{_DATED}[^\[\]]{{0,40}}\]"
_OTHER = r"[A-Z][A-Za-z'’-]{1,25}"
NARRATIVE = rf"(?<![\p{{L}}\p{{N}}_])([A-Z][A-Za-zÀ-ɏ'’-]{{1,25}})\s+(?:et\s+al\.?|and\s+{_OTHER}|&\s*{_OTHER})?\s*\(\s*((?:18|19|20)[0-9]{{2}})[a-z]?\s*\)"
NUMBERS = r"[\[(]\s*[0-9]{1,3}(?:\s*[,;–—-]\s*[0-9]{1,3})*\s*[\])]"
AUTHOR = r"[A-ZÀ-ɏ][A-Za-zÀ-ɏ'’-]{1,24}(?:\s+[A-Z][a-z]+)?,?\s+[A-Z]\.?(?:\s*[A-Z]\.?){0,3}"
BETWEEN = r"(?:\s*[,;&]\s*|\s+and\s+)+"
OPENS = r"(?<![\p{L}\p{N}_])[A-ZÀ-ɏ][\p{L}\p{N}_'’-]+,?\s+(?:[A-Z]\.?\s?){1,4}(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])[eE]t al(?![\p{L}\p{N}_])"
SOURCE = r"(?i)\b[0-9]{1,4}\s*[:(;,]\s*[0-9]|\bdoi\b|10\.[0-9]{4,9}/|https?://|\bpp?\.\s*[0-9]|\bpress\b|\bpublish|\bbiorxiv\b|\bmedrxiv\b|\barxiv\b|\bpreprint\b"
DOI = r"(?i)\b(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\S+)"
STATED = r"^\s*[\[(]?[0-9]{1,3}[\])]?[.\t)]?\s+"


# Joined text


def placed(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, text, start): paragraphs with text and their offset in the joined body, each followed by a space."""
    rows = body(paragraphs).where("text <> ''").select("doc_id", "idx", "text", (F.length("text") + 1).alias("_n"))
    upto = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("doc_id", "idx", "text", (F.sum("_n").over(upto) - F.col("_n")).alias("start"))


def located(paragraphs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, kind, at, idx, start, match): every match in the joined body, with the paragraph and the place in it where it begins.

    patterns: a regular expression for each kind; kinds don't exclude each other.  A paragraph without text holds nothing;
    a document without any gives no row.  Matches are ordered by `at`, the offset in the joined body.
    """
    texts = placed(paragraphs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "idx", "text"))).alias("p"))
    row = lambda kind, i, size, match, p: F.struct(kind.alias("kind"), i.cast("int").alias("i"), size.cast("int").alias("size"), match.alias("match"), p.alias("p"))
    no, nowhere = F.lit(None).cast("string"), F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast(paragraphs.schema["idx"].dataType).alias("idx"))
    marks = F.transform("p", lambda x: row(no, F.lit(0), F.lit(0), no, F.struct(x["start"].alias("start"), x["idx"].alias("idx"))))

    def pieces(joined, kind, rx):
        """The gap before each match and the match; nothing, and no second search, where there is none."""
        split = lambda found: F.transform(F.arrays_zip(F.transform(F.split(joined, rx, -1), F.length).alias("gap"), found.alias("match")), lambda x, i: row(F.lit(kind), i, x["gap"], x["match"], nowhere))
        return let(F.regexp_extract_all(joined, F.lit(rx), F.lit(0)), lambda found: F.when(F.size(found) > 0, split(found)))

    found = lambda joined: F.flatten(F.array_compact(F.array(*[pieces(joined, k, rx) for k, rx in patterns.items()])))
    joined = F.concat(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit(" "))
    # exploded as it is made: a column of its own would be worked out twice, for the filter too
    each = texts.select("doc_id", F.explode(let(let(joined, found), lambda f: F.when(F.size(f) > 0, F.concat(marks, f)))).alias("m")).select("doc_id", "m.*")
    upto = Window.partitionBy("doc_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("match"), F.lit(0))
    placed_ = each.select("doc_id", "kind", "match", F.col("p.idx").alias("_idx"), F.coalesce("p.start", F.sum(F.col("size") + size).over(upto) - size).alias("at"))
    upto = Window.partitionBy("doc_id").orderBy("at", F.col("kind").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("kind").isNull(), F.struct(F.col("_idx").alias("idx"), F.col("at").alias("start")))
    back = placed_.select("doc_id", "kind", "match", "at", F.last(mark, ignorenulls=True).over(upto).alias("p")).where("match is not null")
    return back.select("doc_id", "kind", "at", F.col("p.idx").alias("idx"), (F.col("at") - F.col("p.start")).cast("int").alias("start"), "match")


# Citations


def surnames(c: Column) -> Column:
    """Capitalised words that may be surnames, in order, repeats included."""
    none = F.array(*[F.lit(x) for x in NO_SURNAMES])
    return F.filter(F.regexp_extract_all(c, F.lit(SURNAME), F.lit(1)), lambda w: ~F.array_contains(none, w))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, YEAR, 1), F.lit(""))


def worded(paragraphs: DataFrame) -> DataFrame:
    """The located matches of keys and of names with years, for `cited`."""
    return located(paragraphs, {"keys": KEYS, "round": ROUND, "square": SQUARE, "narrative": NARRATIVE})


def cited(found: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, at, part, key, year, surnames, anchor): citations by key (kind key) and by name (kind name), in one pass.

    found: of `worded`.  A bracket of keys is split at commas and semicolons, and a key must hold a digit; keys keep their letters' case, and
    typographic apostrophes are plain.  A bracket with a year is split at semicolons, and a piece needs a year and a surname; surnames is sorted without repeats.
    """
    inner, no = F.substring("match", F.lit(2), F.length("match") - 2), F.lit(None).cast("string")
    names_ = lambda t: F.array_sort(F.array_distinct(surnames(t)))
    one = lambda key, year_, who: F.struct(key.alias("key"), year_.alias("year"), who.alias("surnames"))
    none = F.lit(None).cast("array<string>")
    by_key = F.transform(F.split(inner, "[,;]"), lambda t: one(F.replace(F.trim(t), F.lit("’"), F.lit("'")), no, none))
    by_name = F.transform(F.split(inner, ";"), lambda t: one(no, year(t), names_(t)))
    told = F.regexp_extract("match", NARRATIVE, 1)
    running = F.array(one(no, F.regexp_extract("match", NARRATIVE, 2), F.filter(F.array(told), lambda w: ~w.isin(NO_SURNAMES))))
    each = F.when(F.col("kind") == "keys", by_key).when(F.col("kind") == "narrative", running).otherwise(by_name)
    rows = found.select("doc_id", F.when(F.col("kind") == "keys", "key").otherwise("name").alias("kind"), "idx", "at", F.left("match", F.lit(60)).alias("anchor"), F.posexplode(each).alias("part", "c"))
    return rows.select("doc_id", "kind", "idx", "at", "part", "c.key", "c.year", "c.surnames", "anchor").where(F.when(F.col("kind") == "key", F.col("key").rlike("[0-9]")).otherwise(F.col("year").isNotNull() & (F.size("surnames") > 0)))


def keys(found: DataFrame) -> DataFrame:
    """(doc_id, at, part, idx, key, anchor) of every key in square brackets that holds a digit.  found: of `worded`."""
    return cited(found).where("kind = 'key'").select("doc_id", "at", "part", "idx", "key", "anchor")


def names(found: DataFrame) -> DataFrame:
    """(doc_id, idx, year, surnames, at, part, anchor) of author-year citations, of those with one paragraph, year and set of surnames the first.  found: of `worded`."""
    return _once(cited(found).where("kind = 'name'").select("doc_id", "idx", "year", "surnames", "at", "part", "anchor"))


def _once(named: DataFrame) -> DataFrame:
    return named.groupBy("doc_id", "idx", "year", "surnames").agg(F.min(F.struct("at", "part", "anchor")).alias("m")).select("doc_id", "idx", "year", "surnames", "m.at", "m.part", "m.anchor")


def _filled(spec: Column) -> Column:
    """The numbers that a list of numbers and ranges names, ranges first; a range of 60 or more, or backwards, names its ends."""
    pieces = F.regexp_extract_all(spec, F.lit(r"[0-9]{1,3}(?:\s*[–—-]\s*[0-9]{1,3})?"), F.lit(0))
    ends = F.transform(pieces, lambda x: F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int")))
    is_range = lambda e: F.coalesce((F.get(e, 1) > F.get(e, 0)) & (F.get(e, 1) - F.get(e, 0) < 60), F.lit(False))
    ranges = F.transform(F.filter(ends, is_range), lambda e: F.sequence(F.get(e, 0), F.get(e, 1)))
    return F.concat(F.flatten(ranges), F.flatten(F.filter(ends, lambda e: ~is_range(e))))


def numbers(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, seq, number, bracket) of every cited number: in square or round brackets, then in superscripts, paragraph by paragraph.

    seq orders the numbers of a paragraph as they are read: brackets before superscripts.  Superscripts count as square brackets.
    """
    rows = body(paragraphs).where("text <> ''")
    bracketed = F.transform(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)), lambda m: F.struct(F.left(m, F.lit(1)).alias("bracket"), _filled(m).alias("numbers")))
    raised = F.array().cast("array<struct<bracket:string,numbers:array<int>>>")
    if "superscript_spans" in paragraphs.columns:
        part = lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"])
        digits = F.filter(F.transform(F.coalesce("superscript_spans", F.array().cast(paragraphs.schema["superscript_spans"].dataType)), part), lambda t: t.rlike(r"^[0-9\s,;–—-]+$") & t.rlike("[0-9]"))
        raised = F.transform(digits, lambda t: F.struct(F.lit("[").alias("bracket"), _filled(t).alias("numbers")))
    each = rows.select("doc_id", "idx", F.posexplode(F.concat(bracketed, raised)).alias("i", "m")).select("doc_id", "idx", "i", "m.bracket", F.posexplode("m.numbers").alias("j", "number"))
    return each.select("doc_id", "idx", F.struct("i", "j").alias("seq"), "number", "bracket")


def notes_of(notes: DataFrame) -> DataFrame:
    """(doc_id, note_id, text): one note for each id; an endnote replaces a footnote of its number, and of repeats the greatest text stands."""
    best = F.max(F.struct((F.col("kind") == "endnote").alias("end"), "text"))
    return notes.groupBy("doc_id", "note_id").agg(best.alias("m")).select("doc_id", "note_id", F.col("m.text").alias("text"))


def noted(paragraphs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, idx, year, surnames, at, part, anchor) of body paragraphs' notes that name a year and, within 160 characters, a surname.

    paragraphs: with footnote_ids; an id that no note has gives nothing.  notes: (doc_id, note_id, text, kind).
    """
    marks = body(paragraphs).where("text <> ''").select("doc_id", "idx", F.posexplode("footnote_ids").alias("at", "note_id"))
    told = marks.join(notes_of(notes), ["doc_id", "note_id"])
    rows = told.select("doc_id", "idx", year(F.col("text")).alias("year"), F.array_sort(F.array_distinct(surnames(F.left("text", F.lit(160))))).alias("surnames"), F.col("at").cast("long").alias("at"), F.lit(0).alias("part"), F.left("text", F.lit(60)).alias("anchor"))
    return _once(rows.where("year is not null and size(surnames) > 0"))


# Entries


def listed(paragraphs: DataFrame) -> DataFrame:
    """The entries of the reference list with what matching needs: bare text, year, surnames near the start, authors in order and counted, and whether it has authors, a source and a DOI."""
    bare = F.trim(F.regexp_replace("text", STATED, ""))
    rows = entries(paragraphs).select("doc_id", "place", "stated", "idx", bare.alias("text")).withColumn("year", year(F.col("text")))
    at = F.regexp_instr("text", F.lit(YEAR))
    zone = F.when(F.col("year").isNotNull() & (at <= 160), F.left("text", at - 1)).otherwise(F.left(F.get(F.split("text", r"\. ", 2), 0), F.lit(160)))
    head = F.get(F.split("text", r"[.?]\s", 2), 0)
    names_ = F.regexp_extract_all("text", F.lit(rf"(?:^|(?!^)\G(?>{BETWEEN}))(?>{AUTHOR})"), F.lit(0))
    cut = F.contains(F.lower(F.left("text", F.lit(220))), F.lit("et al"))
    return rows.select(
        "*", F.array_distinct(surnames(F.left("text", F.lit(180)))).alias("surnames"), F.array_distinct(F.transform(surnames(zone), F.lower)).alias("authors"), F.when(~cut & (F.size(names_) > 0), F.size(names_)).alias("author_count"),
        (head.rlike(r"^\p{Ll}") | (F.size(F.filter(F.split(head, r"\s+"), lambda w: w != "")) < 6) | head.rlike(OPENS)).alias("has_authors"), F.col("text").rlike(SOURCE).alias("has_source"), F.nullif(F.regexp_extract("text", DOI, 1), F.lit("")).alias("doi"),
    )


def _keys() -> Column:
    """The keys by which a citation may name an entry."""

    def made(e):
        authors, year_ = e["authors"], e["year"]
        first, second = F.get(authors, 0), F.get(authors, 1)
        initials = F.array_join(F.transform(F.slice(authors, 1, 4), lambda n: F.left(n, F.lit(1))), "")
        stems = F.array_compact(F.array(F.left(first, F.lit(3)), first, initials, F.concat(initials, F.lit("+")), F.concat(F.left(first, F.lit(3)), F.left(second, F.lit(3)))))
        keys_ = F.array_distinct(F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.right(year_, F.lit(2))), F.concat(s, year_)))))
        return F.when(year_.isNotNull() & (F.size(authors) > 0), keys_).otherwise(F.array().cast("array<string>"))

    return let(F.struct("authors", "year"), made)


def entry_keys(held: DataFrame) -> DataFrame:
    """(doc_id, place, key): the keys by which a citation may name an entry, in lower case.

    held: of `listed`.  An entry with a year and authors a, b, ... has a's first three letters, a, the initials of up to
    four authors, those with a plus sign, and with two authors three letters of each, all before a year of two or of four digits.
    """
    return held.select("doc_id", "place", F.explode(_keys()).alias("key"))


STYLES = ("numeric", "author_year", "key", "note")


def styles(held: DataFrame, numeric: DataFrame, told: DataFrame, in_notes: DataFrame | None = None) -> DataFrame:
    """(doc_id, style, n_cited, n) of every document with entries or citations; n counts its entries.

    held: of `listed`; numeric: of `numbers`; told: of `cited`; in_notes: of `noted`.  The style is the kind with most citations, in the order of STYLES on a tie (names count once for
    a paragraph); unknown without any, with less than twice the others' number where that is over 2, with four or more numbers of which over half lie beyond the list, and by
    name or key without any year in the list.  All citations and entries go through two groupings, by what they say and by document.
    """
    no = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, kind, **c: df.select("doc_id", kind.alias("kind"), *[c.get(n, no(t)).alias(n) for n, t in (("number", "int"), ("idx", "int"), ("year", "string"), ("who", "string"))])
    who = F.array_join("surnames", " ")
    parts = [shape(held, F.lit("entry"), number=F.col("stated").cast("int"), year=F.col("year")), shape(numeric, F.lit("numeric"), number=F.col("number").cast("int"))]
    parts.append(shape(told, F.when(F.col("kind") == "key", "key").otherwise("author_year"), idx=F.when(F.col("kind") == "name", F.col("idx")), year=F.col("year"), who=who))
    if in_notes is not None:
        parts.append(shape(in_notes, F.lit("note"), idx=F.col("idx"), year=F.col("year"), who=who))
    both = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "kind", "number", "idx", "year", "who").agg(F.count("*").alias("c"))
    of = lambda kind: F.col("kind") == kind
    once = lambda kind: F.count_if(of(kind))
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("c"))), F.lit(0))
    per = both.groupBy("doc_id").agg(
        total("entry").alias("n"), total("numeric").alias("numeric"), once("author_year").alias("author_year"), total("key").alias("key"), once("note").alias("note"), F.coalesce(F.max(F.when(of("entry"), F.col("number"))), F.lit(0)).alias("stated"),
        F.bool_or(of("entry") & F.col("year").isNotNull()).alias("dated"), F.collect_set(F.when(of("numeric"), F.col("number"))).alias("cited"),  # numbers of three digits
    )
    best = F.greatest(*STYLES)
    all_ = F.col("numeric") + F.col("author_year") + F.col("key") + F.col("note")
    name = F.coalesce(*[F.when(F.col(s) == best, F.lit(s)) for s in STYLES])
    mixed = (best < 2 * F.greatest(F.lit(1), all_ - best)) & (all_ - best > 2)
    most = F.greatest("n", "stated")
    outside = (name == "numeric") & (F.col("n") > 0) & (F.size("cited") >= 4) & (2 * F.size(F.filter("cited", lambda x: x > most)) > F.size("cited"))
    undated = name.isin("author_year", "key") & ~F.col("dated")
    return per.select("doc_id", F.when((best == 0) | mixed | outside | undated, "unknown").otherwise(name).alias("style"), all_.alias("n_cited"), "n")


# Issues


def _lost(cited_: DataFrame, listed_: DataFrame) -> DataFrame:
    """(doc_id, side, me) of the citations (side c) and entries (side e) that share no word with the other side of their document.

    Both have doc_id, me (a struct of one shape) and words, an array without nulls.  A row holds what one document cites and lists, so a document is
    matched where it lies; the words of one side are gathered once for the other.
    """
    side = lambda df, name: df.groupBy("doc_id").agg(F.collect_list(F.struct("me", "words")).alias(name))
    both = side(cited_, "c").join(side(listed_, "e"), "doc_id", "full")
    none = F.array().cast("array<string>")
    words = lambda c: F.coalesce(F.array_distinct(F.flatten(F.transform(c, lambda x: x["words"]))), none)
    alone = lambda own, other: let(words(F.col(other)), lambda w: F.filter(F.col(own), lambda x: ~F.arrays_overlap(x["words"], w)))
    marked = lambda own, other: F.coalesce(F.transform(alone(own, other), lambda x: F.struct(F.lit(own).alias("side"), x["me"].alias("me"))), F.array().cast(f"array<struct<side:string,me:{cited_.schema['me'].dataType.simpleString()}>>"))
    return both.select("doc_id", F.explode(F.concat(marked("c", "e"), marked("e", "c"))).alias("x")).select("doc_id", "x.side", "x.me")


def _me(idx: Column, what: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), what.cast("string").alias("what"))


def _missing_and_unused(lost: DataFrame, where: str) -> DataFrame:
    rows = lost.select("doc_id", "side", "me.idx", "me.what")
    code = F.when(F.col("side") == "c", f"{where}_missing").otherwise(f"{where}_unused")
    return rows.select("doc_id", F.lit(CHECK).alias("check"), F.lit("error").alias("severity"), code.alias("code"), F.col("idx").alias("para_index"), F.col("what").alias("detail"))


def key_issues(held: DataFrame, keyed: DataFrame) -> DataFrame:
    """Keys that name no entry (once each, where they stand first) and entries with keys that no citation names."""
    low = keyed.withColumn("key", F.lower("key")).groupBy("doc_id", "key").agg(F.min(F.struct("at", "part", "idx")).alias("m"))
    cite = low.select("doc_id", _me(F.col("m.idx"), F.col("key")).alias("me"), F.array("key").alias("words"))
    # exploded as they are made: a filter on the keys would work them out twice
    own = held.select("doc_id", _me(F.col("idx"), F.col("place")).alias("me"), F.explode(let(_keys(), lambda k: F.when(F.size(k) > 0, F.array(k)))).alias("words"))
    return _missing_and_unused(_lost(cite, own), "key")


def name_issues(held: DataFrame, named: DataFrame, where: str = "name") -> DataFrame:
    """Author-year citations without an entry of that year that shares a surname, and entries that no citation names."""
    dated = F.when(F.col("year").isNotNull(), F.transform("surnames", lambda s: F.concat_ws(" ", "year", s))).otherwise(F.array().cast("array<string>"))
    cite = named.select("doc_id", _me(F.col("idx"), F.concat_ws(" ", F.get("surnames", 0), "year")).alias("me"), dated.alias("words"))
    own = held.select("doc_id", _me(F.col("idx"), F.col("place")).alias("me"), dated.alias("words"))
    return _missing_and_unused(_lost(cite, own), where)


def number_issues(held: DataFrame, numeric: DataFrame) -> dict[str, DataFrame]:
    """Numbers without an entry, entries without a citation, and numbers cited out of order, as errors, errors and warnings.

    Numbers in round brackets beyond the list are no citations.  An entry's number is the one it states, or else its place; the
    last entry of a number is meant.  More late numbers than a fifth of the list (and than 2) are one info; else the first ten are named.
    """
    size = held.groupBy("doc_id").agg(F.count("*").alias("total"))
    cited = numeric.join(size, "doc_id").where("not (bracket = '(' and number > total)")
    own = held.groupBy("doc_id", F.coalesce("stated", "place").cast("int").alias("number")).agg(F.max_by("idx", "place").alias("idx"))
    first = cited.groupBy("doc_id", "number", "total").agg(F.min(F.struct("idx", "seq")).alias("m")).select("doc_id", "number", "total", "m.idx", "m.seq")
    known = first.join(own.select("doc_id", "number"), ["doc_id", "number"], "left_semi")
    before = Window.partitionBy("doc_id").orderBy("idx", "seq").rowsBetween(Window.unboundedPreceding, -1)
    late = known.withColumn("before", F.max("number").over(before)).where("number < before")
    ranked = late.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "seq"))).withColumn("late", F.count("*").over(Window.partitionBy("doc_id")))
    many = F.col("late") > F.greatest(F.lit(2), 0.2 * F.col("total"))
    return {
        "no_reference": issue(first.join(own, ["doc_id", "number"], "left_anti"), CHECK, "error", "no_reference", F.col("number")),
        "never_cited": issue(own.join(first, ["doc_id", "number"], "left_anti"), CHECK, "error", "never_cited", F.col("number")),
        "citation_order": issue(ranked.where(~many & (F.col("k") <= 10)), CHECK, "warning", "citation_order", F.concat_ws(" after ", "number", "before")),
        "out_of_order": issue(ranked.where(many & (F.col("k") == 1)), CHECK, "info", "out_of_order", F.concat_ws("/", "late", "total"), None),
    }


#: How many entries of a kind are named at most, and how many a gate lets through: these or a share of the list.
NO_AUTHORS, NO_SOURCE, NO_YEAR, NO_DOI, GATE, SHARE = 8, 6, 6, 12, 3, 0.2


def entry_issues(held: DataFrame) -> DataFrame:
    """Issues of the entries themselves, whatever the style.

    held: of `listed`.  Stated numbers are judged where four in five entries, and more than one, state them.  Entries without a source or a year are named only where
    few are so (three, or a fifth of the list), and missing DOIs only where half the entries have one.  Everything lies within a document.
    """
    own = held.withColumn("same", F.left(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), F.lit(90))).repartition("doc_id")
    order = Window.partitionBy("doc_id").orderBy("place")
    rows = own.withColumn("twin", F.min("place").over(Window.partitionBy("doc_id", "same"))).withColumn("before", F.last("stated", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sourceless = F.col("has_authors") & F.col("year").isNotNull() & ~F.col("has_source")
    kept = F.struct("place", "idx", "stated", "before", "twin", "doi", (~F.col("has_authors")).alias("unsigned"), sourceless.alias("sourceless"), F.col("year").isNull().alias("undated"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("e"))  # one document's list
    n = F.size("e")
    made = lambda code, severity, idx, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), idx.alias("idx"), detail.cast("string").alias("detail"))
    none = F.array().cast("array<struct<severity:string,code:string,idx:int,detail:string>>")
    each = lambda code, severity, some, detail: F.transform(some, lambda x: made(code, severity, x["idx"], detail(x)))
    few = lambda some: (F.size(some) > 0) & (F.size(some) <= F.greatest(F.lit(float(GATE)), SHARE * n))
    stated = F.filter("e", lambda x: x["stated"].isNotNull())
    wrong = F.filter(stated, lambda x: x["before"].isNotNull() & (x["stated"] != x["before"] + 1))
    numbered = F.when((F.size(stated) > 1) & (F.size(stated) >= 0.8 * n), F.transform(wrong, lambda x: made("numbering", "warning", F.get(F.filter(stated, lambda y: y["stated"] == x["stated"]), 0)["idx"], F.when(x["stated"] == x["before"], F.concat(F.lit("twice "), x["stated"])).otherwise(F.concat_ws(" to ", x["before"].cast("string"), x["stated"].cast("string"))))))
    marked = lambda c: F.filter("e", lambda x: x[c])
    unsigned, sourceless, undated = marked("unsigned"), marked("sourceless"), marked("undated")
    without = F.filter("e", lambda x: x["doi"].isNull())
    more = F.when(F.size(without) > NO_DOI, F.concat(F.lit(" and "), F.size(without) - NO_DOI, F.lit(" more"))).otherwise("")
    named = F.concat((n - F.size(without)).cast("string"), F.lit("/"), n.cast("string"), F.lit(": "), F.array_join(F.transform(F.slice(without, 1, NO_DOI), lambda x: x["place"].cast("string")), ", "), more)
    bad = F.filter("e", lambda x: x["doi"].isNotNull() & ~F.rtrim(x["doi"], F.lit(".,;")).rlike(r"^10\.[0-9]{4,9}/\S+$"))
    place = lambda x: x["place"]
    all_ = F.concat(
        F.coalesce(numbered, none), each("duplicate_entry", "warning", F.filter("e", lambda x: x["twin"] < x["place"]), lambda x: F.concat_ws("=", x["place"].cast("string"), x["twin"].cast("string"))), each("no_authors", "warning", F.slice(unsigned, 1, NO_AUTHORS), place),
        F.when(few(sourceless), each("no_source", "warning", F.slice(sourceless, 1, NO_SOURCE), place)).otherwise(none), F.when(few(undated), each("no_year", "info", F.slice(undated, 1, NO_YEAR), place)).otherwise(none),
        F.when((F.size(without) > 0) & (2 * F.size(without) <= n), F.array(made("doi_coverage", "info", F.get(without, 0)["idx"], named))).otherwise(none), each("bad_doi", "warning", bad, lambda x: x["doi"]),
    )
    found = per.select("doc_id", F.explode(all_).alias("i")).select("doc_id", "i.*")
    return found.select("doc_id", F.lit(CHECK).alias("check"), "severity", "code", F.col("idx").cast("int").alias("para_index"), "detail")


def issues(paragraphs: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """All issues of citations and references: each document's citations are held against its list in its own style.

    notes: (doc_id, note_id, text, kind), where paragraphs have footnote_ids.  A document with citations and no list has one info; a style that isn't known, or no citations, is one too, and then only the
    entries are judged.
    """
    held, numeric, told = listed(paragraphs), numbers(paragraphs), cited(worded(paragraphs))
    in_notes = None if notes is None else noted(paragraphs, notes)
    style = styles(held, numeric, told, in_notes)
    of = lambda df, name: df.join(style.where((F.col("style") == name) & (F.col("n") > 0)).select("doc_id"), "doc_id", "left_semi")
    named = _once(told.where("kind = 'name'").select("doc_id", "idx", "year", "surnames", "at", "part", "anchor"))
    unknown = style.where("n > 0 and style = 'unknown'")
    parts = [
        issue(style.where("n = 0 and n_cited > 0"), CHECK, "info", "no_list", F.col("n_cited"), None), issue(unknown.where("n_cited = 0"), CHECK, "info", "no_citations", F.col("n"), None), issue(unknown.where("n_cited > 0"), CHECK, "info", "style_unknown", F.col("n_cited"), None),
        *number_issues(of(held, "numeric"), of(numeric, "numeric")).values(), name_issues(of(held, "author_year"), of(named, "author_year")), key_issues(of(held, "key"), of(told.where("kind = 'key'").select("doc_id", "at", "part", "idx", "key", "anchor"), "key")), entry_issues(held),
    ]
    if in_notes is not None:
        parts.append(name_issues(of(held, "note"), of(in_notes, "note"), "note"))
    return reduce(DataFrame.unionByName, parts)
