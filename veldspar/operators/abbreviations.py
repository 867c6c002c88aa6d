"""Abbreviations: where they are defined, what they stand for, where they are used, in DataFrame functions alone.

A paragraph's definitions and uses are found together in its row, so a use inside a definition's brackets is left out
without a join.  Paragraphs have doc_id, idx, text, section and is_heading; only the abstract, the main text and the methods count.
The word lists are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.text import let, pieces, places, unmarked

CHECK = "abbreviations"
# How a long form, a short form and a use look, small words, and capitals that are no short forms.
_W = r"[\p{L}\p{N}_'’/-]"
_TERM = rf"[A-Za-z]{_W}*(?:[ ‐-][A-Za-z]{_W}*)"
_SHORT = r"[A-Za-z]?[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9-]{0,8}"
_NUMBER = r"(?:[0-9]{1,2}[-‐–]\s*)?"
#: "(LF, n = 6)" after a long form, and "(long form; LF)"; groups: what stands before the short form, the long form inside, the short form, what follows it.
BRACKET = rf"([(\[]{_NUMBER})()({_SHORT})s?(\s*[,;]\s*[^)\]]{{0,45}})?[)\]]"
INSIDE = rf"([(\[]({_TERM}{{1,6}})\s*[;,]\s*{_NUMBER})({_SHORT})s?()[)\]]"
#: Up to seven words at the end of a text, read backwards.
_BACK = rf"^\s*((?:{_W}*[A-Za-z][ ‐-]){{0,6}}{_W}*[A-Za-z])"
USE = r"(?<![\p{L}\p{N}_])(?:[0-9]{1,2}[-‐–])?[a-z]?[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9-]{0,8}(?![\p{L}\p{N}_])"
#: INSIDE with one way to read each text: a hyphen is a letter of a word, and one separator of any kind stands somewhere.
_INSIDE = rf"([(\[]((?=[A-Za-z]{_W}*[ ‐-][A-Za-z])[A-Za-z]{_W}*+(?:[ ‐][A-Za-z]{_W}*+){{0,6}})\s*[;,]\s*{_NUMBER})({_SHORT})s?()[)\]]"
#: What every short form and use holds, and a vendor with its place.
_CAPITALS = "[A-Z][A-Za-z0-9]*[A-Z]"
VENDOR = r"[(,]\s*([A-Z]{3,8})(?=\s*,\s*[^)]{2,45}\))"
SMALL = "of the and for in on to a an with by".split()
NEVER = "FIGURE FIGURES TABLE TABLES AND THE OR IN OF FOR WITH SUPPLEMENTARY EXTENDED DATA".split()
#: Short forms that nobody has to spell out, by field.
STANDARD = (
    "DNA RNA CDNA MRNA RRNA TRNA PCR QPCR ATP ADP NADH BSA PBS EDTA DMSO SDS HEPES TRIS "  # molecules and buffers
    "HPLC NMR ELISA FACS MALDI TOF UPLC UV IR "  # methods
    "SD SE SEM CI IQR ANOVA PCA ROC AUC GLM FDR "  # statistics
    "BMI MRI CT PET ECG ICU HIV AIDS COVID TB "  # clinic
    "US USA UK EU WHO NIH NSF FDA EMA CDC "  # countries and offices
    "CPU GPU RAM API URL PDF HTML XML CSV AI ML ID "  # computing
    "DOI ISBN ORCID PMID NCBI EMBL BLAST KEGG GO GEO SRA"  # records and databases
).split()
ORGANISATION = r"(?i)(?<![\p{L}\p{N}_])(?:universit|institut|college|school|hospital|clinic|cent(?:er|re)|foundation|academy|society|association|consortium|ministry|department|laborator|company|corporation|inc\b|ltd\b|gmbh)"

#: The same, with a look at the first letter before the one behind it.
_ORGANISATION = ORGANISATION.replace("(?i)", "(?i)(?=[acdfghilmsu])", 1)


def zone() -> Column:
    """abstract, main or methods; null elsewhere."""
    section = F.col("section")
    return F.when(section.isin("abstract", "methods"), section).when(section.isin("introduction", "results", "discussion", "conclusions"), "main")


def normal(short: Column) -> Column:
    """A short form without the number before it and without a plural s after capitals; patterns run only where the first and last character call for them."""
    bare = F.when(short.between("0", ":"), F.regexp_replace(short, r"^[0-9]{1,2}[-‐–]\s*", "")).otherwise(short)
    return F.when(bare.endswith("s") & bare.rlike("^[^a-z]*[A-Z][^a-z]*s$"), F.regexp_replace(bare, "s+$", "")).otherwise(bare)


def letters_of(short: Column) -> Column:
    return F.regexp_extract_all(F.lower(short), F.lit(r"\p{L}"), F.lit(0))


def in_order(text: Column, letters: Column) -> Column:
    """Whether the letters stand in this order in the end of the text: eight characters for each, and ten.

    A fold over the letters: the state is the place after the last one found, or -1 once one is missing.
    """
    end = F.lower(F.right(text, F.lit(8) * F.size(letters) + 10))
    place = lambda c, at: F.call_function("locate", c, end, at + 1)
    return F.aggregate(letters, F.lit(0), lambda at, c: F.when(at < 0, at).when(place(c, at) > 0, place(c, at)).otherwise(F.lit(-1))) >= 0


def expansion(term: Column, letters: Column) -> Column:
    """The shortest end of a term whose words' initials, small words aside, are the letters: null if none is.

    Words are split at white space, and if that gives nothing at hyphens too; up to three more words than letters are tried.
    """

    def read(parts):
        counts = F.filter(F.array(*[F.size(letters) + k for k in range(4)]), lambda n: (n <= F.size(parts)) & (n > 0))
        initials = F.transform(parts, lambda w: let(F.lower(w), lambda x: F.when(x.isin(SMALL), "").otherwise(F.left(x, F.lit(1)))))
        agree = lambda all_: F.filter(counts, lambda n: F.array_remove(F.slice(all_, F.size(all_) - n + 1, n), "") == letters)
        return F.transform(let(initials, agree), lambda n: F.slice(parts, F.size(parts) - n + 1, n))

    split = lambda rx: F.filter(F.split(term, rx), lambda w: w != "")
    first = lambda rx: F.array_join(F.get(let(split(rx), read), 0), " ")
    return F.coalesce(first(r"\s+"), first(r"[\s‐-]+"))


def _plausible(short: Column, term: Column, lead: Column, letters: Column) -> Column:
    words = F.split(F.trim(term), r"\s+")
    capitals = F.length(F.regexp_replace(short, "[^A-Z]", ""))
    enough = F.size(words) >= F.least(F.lit(2), capitals)
    same = F.lower(F.left(term, F.lit(1))) == F.lower(F.left(short, F.lit(1)))
    return (F.length(short) >= 2) & ~F.upper(short).isin(NEVER) & ~F.upper(F.element_at(words, -1)).isin(NEVER) & (enough | same | in_order(F.when(lead != "", lead).otherwise(term), letters))


def _brackets(text: Column, parts: Column, at: Column, pattern: str) -> Column:
    """The matches of a definition's pattern: the short form and its place, the long form, what stands before, and whether the bracket holds more.

    A long form before a bracket is read backwards from it, so its words are looked at once.
    """

    def one(k):
        part = lambda g: F.regexp_extract(F.get(parts, k), pattern, g)
        if pattern == BRACKET:
            back = F.regexp_extract(F.reverse(F.get(parts, k - 1)), _BACK, 0)
            read = F.struct(F.length(part(1)).alias("front"), part(3).alias("short"), F.reverse(F.regexp_replace(back, r"^\s+", "")).alias("term"), F.length(back).alias("size"), (part(4) != "").alias("extra"))
        else:
            read = F.struct(F.length(part(1)).alias("front"), part(3).alias("short"), part(2).alias("term"), F.lit(0).alias("size"), F.lit(False).alias("extra"))

        def told(r):
            start = F.get(at, k) + r["front"]
            low = F.greatest(F.get(at, k) - r["size"] - 90, F.lit(0))
            return F.struct(normal(r["short"]).alias("abbr"), F.trim(r["term"]).alias("term"), start.alias("start"), (start + F.length(r["short"])).alias("stop"), F.substring(text, low + 1, start - low).alias("lead"), r["extra"].alias("extra"))

        return let(read, told)

    return F.filter(F.transform(_places_of(parts), one), lambda d: d["term"] != "")


def _places_of(parts: Column) -> Column:
    """Where the matches are among the pieces."""
    return F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))


def _told(*found: Column) -> Column:
    """A paragraph's definitions: those that can be one, and with more in the bracket only where the initials agree."""

    def full(d):
        return let(letters_of(d["abbr"]), lambda ls: F.struct(d["abbr"].alias("abbr"), d["term"].alias("term"), d["start"].alias("start"), d["stop"].alias("stop"), d["lead"].alias("lead"), d["extra"].alias("extra"), expansion(d["term"], ls).alias("expansion"), _plausible(d["abbr"], d["term"], d["lead"], ls).alias("can")))

    return F.filter(F.transform(F.concat(*found), full), lambda d: d["can"] & (~d["extra"] | d["expansion"].isNotNull()))


_TOLD = "array<struct<abbr:string,term:string,start:int,stop:int,lead:string,extra:boolean,expansion:string,can:boolean>>"
_ENTRY = "array<struct<kind:string,abbr:string,start:int,expansion:string,term:string,lead:string>>"


def _used(parts: Column, at: Column, told: Column, run: int = 64) -> Column:
    """A paragraph's uses as they are written: not in quotes and not in a definition's brackets.

    The sides of a use are the ends of the pieces beside it.  Uses are taken in runs, each with the definitions that reach into it.
    """
    last = F.size(parts) - 2

    def keep(near):
        def one(k):
            before, after = F.get(parts, k - 1), F.get(parts, k + 1)
            # an empty piece between two uses is no end of the text
            quoted = F.right(before, F.lit(1)).isin("'", "‘", "“", '"') & (F.left(after, F.lit(1)).isin("'", "’", "”", '"') | ((after == "") & (k == last)))
            return ~quoted & ~F.exists(near, lambda d: (F.get(at, k) < d["stop"]) & (F.get(at, k + 1) > d["start"]))

        return one

    entry = lambda k: F.struct(F.lit("u").alias("kind"), F.get(parts, k).alias("abbr"), F.get(at, k).alias("start"), *[F.lit(None).cast("string").alias(n) for n in ("expansion", "term", "lead")])
    all_ = _places_of(parts)
    within = lambda ks: F.filter(told, lambda d: (F.get(at, F.get(ks, 0)) < d["stop"]) & (F.get(at, F.get(ks, F.size(ks) - 1) + 1) > d["start"]))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / (2 * run)).cast("int")), lambda n: F.slice(all_, n * run + 1, F.lit(run)))
    long_ = F.flatten(F.transform(runs, lambda ks: let(within(ks), lambda near: F.filter(ks, keep(near)))))
    return F.transform(F.when(last < 2 * run, F.filter(all_, keep(told))).otherwise(long_), entry)


def read(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, zone, kind, abbr, start, expansion, term, lead): a row for each definition (kind d), use (kind u) and vendor (kind v) of a paragraph.

    expansion is null where the initials don't agree; a use has neither term nor lead.  Paragraphs outside the zones, headings and blanks have neither
    definitions nor uses; a vendor, of any paragraph, has nothing but its name.  Texts are read once, and each pattern runs over them once.
    """
    text, no = F.col("text"), F.lit(None)
    rows = paragraphs.where(text.rlike(_CAPITALS)).select("doc_id", "idx", "text", unmarked(text).alias("clean"), F.when(~F.coalesce("is_heading", F.lit(False)), zone()).alias("zone"))
    clean, body, open_ = F.col("clean"), F.col("zone").isNotNull(), text.rlike(r"[(\[]")
    cut = rows.select("*", F.when(body, pieces(clean, USE)).alias("u"), F.when(body & open_, pieces(clean, BRACKET)).alias("b"), F.when(body & open_, pieces(clean, _INSIDE)).alias("i"), F.when(text.rlike(VENDOR), F.regexp_extract_all(text, F.lit(VENDOR), F.lit(1))).alias("v"))
    set_ = cut.select("*", *[places(F.col(n)).alias(f"{n}_at") for n in "ubi"])
    told = F.when(F.size("b") + F.size("i") > 2, _told(_brackets(text, F.col("b"), F.col("b_at"), BRACKET), _brackets(text, F.col("i"), F.col("i_at"), _INSIDE)))
    known = set_.select("doc_id", "idx", "zone", "u", "u_at", "v", F.coalesce(told, F.array().cast(_TOLD)).alias("told"))
    empty = F.array().cast(_ENTRY)
    made = F.transform("told", lambda d: F.struct(F.lit("d").alias("kind"), d["abbr"].alias("abbr"), d["start"].alias("start"), d["expansion"].alias("expansion"), d["term"].alias("term"), d["lead"].alias("lead")))
    used = F.when(F.size("u") > 1, _used(F.col("u"), F.col("u_at"), F.col("told")))
    sold = F.transform("v", lambda v: F.struct(F.lit("v").alias("kind"), v.alias("abbr"), no.cast("int").alias("start"), *[no.cast("string").alias(n) for n in ("expansion", "term", "lead")]))
    each = known.select("doc_id", "idx", "zone", F.explode(F.concat(made, F.coalesce(used, empty), F.coalesce(sold, empty))).alias("e")).select("doc_id", "idx", "zone", "e.*")
    use = F.col("kind") == "u"
    named = each.withColumn("abbr", F.when(use, normal(F.col("abbr"))).otherwise(F.col("abbr")))
    # a use has two capitals at least, so it is long enough
    return named.where(~use | ~F.upper("abbr").isin(NEVER))


def definitions(found: DataFrame) -> DataFrame:
    """(doc_id, idx, zone, abbr, start, expansion, term, lead) of `read`."""
    return found.where("kind = 'd'").select("doc_id", "idx", "zone", "abbr", "start", "expansion", "term", "lead")


def uses(found: DataFrame) -> DataFrame:
    """(doc_id, idx, zone, abbr, start) of `read`."""
    return found.where("kind = 'u'").select("doc_id", "idx", "zone", "abbr", "start")


def vendors(found: DataFrame) -> DataFrame:
    """(doc_id, abbr) of `read`: capitals that a bracket names with a place after them, as in "(QIAGEN, Germany)", in any section."""
    return found.where("kind = 'v'").select("doc_id", "abbr").distinct()


def terms(paragraphs: DataFrame, found: DataFrame, standard: Iterable[str] = tuple(STANDARD)) -> DataFrame:
    """One row for each short form of a document: what its definitions, uses and vendors' brackets say, and whether it is exempt.

    found: of `read` over the paragraphs, which aren't read again.  (doc_id, abbr, common, named, sure, first, last, used, n_used, vendor): common is false for
    standard short forms; named says whether a definition's words are those of an organisation; sure holds the definitions whose initials agree, in order;
    first and last are the places of the first and last definition, used that of the first use.  All of it is grouped once.
    """
    named = F.col("kind").eqNullSafe("d") & F.concat_ws(" ", "lead", "term").rlike(_ORGANISATION)
    each = found.select("doc_id", "abbr", "kind", "idx", "start", "zone", "expansion", named.alias("named"))
    at, of = F.struct("idx", "start"), lambda kind: F.col("kind") == kind
    per = each.groupBy("doc_id", "abbr").agg(
        F.array_sort(F.collect_list(F.when(of("d") & F.col("expansion").isNotNull(), F.struct("idx", "start", "zone", "expansion")))).alias("sure"),  # of one short form in one document
        F.min(F.when(of("d"), at)).alias("first"), F.max(F.when(of("d"), at)).alias("last"), F.min(F.when(of("u"), at)).alias("used"), F.count_if(of("u")).alias("n_used"), F.bool_or("named").alias("named"), F.bool_or(of("v")).alias("vendor"),
    )
    return per.select("doc_id", "abbr", (~F.upper("abbr").isin([x.upper() for x in sorted(set(standard))])).alias("common"), "named", "sure", "first", "last", "used", "n_used", "vendor")


def issues(per: DataFrame, listed: int = 8) -> DataFrame:
    """Issues of abbreviations.

    per: of `terms`.  A definition counts for repeats, spellings and use only where the initials agree, and one in the methods needs no use.  Short forms of
    three to eight capitals that are used three times and never defined are one issue of a document, which names the first `listed`.
    """
    zones = F.array(*[F.lit(z) for z in ("abstract", "main", "methods")])
    twice = F.filter(F.transform(zones, lambda z: F.struct(z.alias("zone"), F.filter("sure", lambda d: d["zone"] == z).alias("d"))), lambda x: F.size(x["d"]) > 1)
    key = lambda d: F.regexp_replace(F.lower(d["expansion"]), "s+$", "")
    # the first of each spelling
    spelt = F.filter("sure", lambda d, i: ~F.exists(F.slice("sure", F.lit(1), i), lambda e: key(e) == key(d)))
    idle = F.filter("sure", lambda d: d["zone"] != "methods")
    made = lambda code, severity, idx, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), idx.alias("idx"), detail.alias("detail"))
    own = F.array_compact(
        F.concat(
            F.array(F.when(F.col("used") < F.col("first"), made("used_before_defined", "warning", F.col("used.idx"), F.col("abbr")))),
            F.transform(twice, lambda x: made("defined_twice", "warning", F.get(x["d"], 1)["idx"], F.concat_ws(" ", F.col("abbr"), x["zone"], F.size(x["d"]).cast("string")))),
            F.array(F.when(F.size(spelt) > 1, made("differing_expansions", "warning", F.col("last.idx"), F.concat(F.col("abbr"), F.lit(": "), F.array_join(F.array_sort(F.transform(spelt, lambda d: d["expansion"])), "; "))))),
            F.array(F.when((F.size(idle) > 0) & (F.col("n_used") == 0), made("never_used", "info", F.get(idle, 0)["idx"], F.col("abbr")))),
        )
    )
    told = F.col("first").isNotNull() & F.col("common") & ~F.col("named")
    lost = F.col("first").isNull() & F.col("common") & ~F.col("vendor") & (F.col("n_used") >= 3) & F.col("abbr").rlike("^[A-Z]{3,8}$")
    none = F.array().cast("array<struct<severity:string,code:string,idx:int,detail:string>>")
    # one grouping by document for both, so that what was read is used once
    all_ = per.select("doc_id", F.when(told, own).otherwise(none).alias("own"), F.when(lost, F.struct("abbr", "n_used", "used")).alias("lost")).groupBy("doc_id").agg(F.flatten(F.collect_list("own")).alias("own"), F.array_sort(F.collect_list("lost")).alias("a"))
    names = F.array_join(F.transform(F.slice("a", 1, listed), lambda x: F.concat_ws(" ", x["abbr"], x["n_used"])), ", ")
    last = F.when(F.size("a") > 0, F.array(made("never_defined", "info", F.get("a", 0)["used"]["idx"], names))).otherwise(none)
    rows = all_.select("doc_id", F.explode(F.concat("own", last)).alias("i")).select("doc_id", "i.*")
    return rows.select("doc_id", F.lit(CHECK).alias("check"), "severity", "code", F.col("idx").cast("int").alias("para_index"), "detail")
