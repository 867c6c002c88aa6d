"""Legends that go on over several paragraphs, and the callouts that stand outside them, in DataFrame functions alone.

A document's paragraphs fall into runs: a blank paragraph, a heading or the start of a legend opens one.  A run belongs to its legend if the
legend opens it and the next paragraph opens with a panel; what a legend has absorbed is no place for callouts.  Runs are numbered
by a running sum over each document, so the plan has one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import matches

# How a legend, a callout and a panel look.
_PREFIX = r"((?:Supp(?:l(?:ement(?:ary|al)?)?)?\.?|Extended\s+Data|Online\s+Resource)\s*)?"
LEGEND = (
    rf"(?i)^\s*{_PREFIX}(Fig(?:ure)?\.?|Table)\s*(S?[0-9]+)(?:\s*,\s*(?:related|corresponding|associated|linked)\s+to[^.]{{0,80}})?\s*(?:[.:;|–—-]|,\s+(?-i:[A-Z])|\s+(?-i:[A-Z][a-z]))"
)
_ITEM, _SEP = r"S?[0-9]+[A-Za-z]?(?![A-Za-z0-9])", r"\s*(?:[–—-]|,|;|and|&)\s*"
CALLOUT = rf"(?i)(?=[seoft])\b{_PREFIX}(Fig(?:ure)?s?\.?|Tables?)\s*({_ITEM}(?:{_SEP}(?:{_ITEM}|[A-Za-z](?![A-Za-z0-9])))*)"
PANEL = r"^\s*\(?[A-Za-z]\)"
REFERENCE = r"(?i)\bet al\b|\bdoi\b|\bpp?\.\s*[0-9]|\b(?:19|20)[0-9][0-9][;:)]|\bvol\b"
TOKEN = r"[Ss]?[0-9]+[A-Za-z]?|[A-Za-z]+|[–—-]|[,;&]"
#: Numbers between the ends of a range; a wider one names its ends.
WIDEST = 1000
_OUT = "array<struct<label:string,panel:string>>"


# What a callout names


def _letters(a: Column, b: Column) -> Column:
    """The capital letters from one to another, whichever comes first."""
    low, high = F.least(F.ascii(a), F.ascii(b)), F.greatest(F.ascii(a), F.ascii(b))
    return F.transform(F.sequence(low, high), lambda n: F.chr(n))


def _token(t: Column) -> Column:
    """What a token is and names, worked out once: the fold over tokens then only compares."""
    item = t.rlike(r"^[Ss]?[0-9]")
    label = F.when(item, F.upper(F.regexp_extract(t, r"^([Ss]?[0-9]+)", 1))).otherwise("")
    return F.struct(
        F.when(item, "item").when(t.isin("-", "–", "—"), "dash").when(t.isin(",", ";", "&") | (F.lower(t) == "and"), "sep").when(F.length(t) == 1, "letter").otherwise("word").alias("is"), label.alias("label"),
        F.when(item, F.regexp_replace(label, "[^0-9]", "").try_cast("long")).alias("number"), F.when(item, F.regexp_extract(t, r"[0-9]([A-Za-z])$", 1)).otherwise("").alias("panel"), F.upper(t).alias("up"), (F.upper(t) == t).alias("capital"),
    )


def _step(a: Column, t: Column) -> Column:
    """The state after one more token (of `_token`): an item, a dash, a separator, a panel letter or a word that ends the callout."""
    dash, sep, item = t["is"] == "dash", t["is"] == "sep", t["is"] == "item"
    label, panel, up = t["label"], t["panel"], t["up"]
    letter = (t["is"] == "letter") & (a["label"] != "") & (t["capital"] | a["lower"])
    low, high = a["number"], t["number"]
    spans = a["dash"] & (a["label"] != "") & (a["panel"] == "") & (high - low > 1) & (high - low < WIDEST)
    named = lambda text, letter_: F.struct(text.alias("label"), letter_.alias("panel"))
    none = F.array().cast(_OUT)
    between = F.when(spans, F.transform(F.sequence(low + 1, high - 1), lambda n: named(F.concat(F.when(label.startswith("S"), "S").otherwise(""), n.cast("string")), F.lit("")))).otherwise(none)
    panels = F.when(a["dash"] & (a["panel"] != ""), _letters(a["panel"], up)).otherwise(F.array(up))
    more = F.when(item, F.concat(between, F.array(named(label, F.upper(panel))))).when(letter, F.transform(panels, lambda p: named(a["label"], p))).otherwise(none)
    pick = lambda of_item, of_letter, of_dash, of_sep, name: F.when(item, of_item).when(letter, of_letter).when(dash, of_dash).when(sep, of_sep).otherwise(a[name]).alias(name)
    after = F.struct(
        pick(label, a["label"], a["label"], a["label"], "label"), F.when(item, high).otherwise(low).alias("number"), pick(F.upper(panel), up, a["panel"], a["panel"], "panel"),
        pick(F.when(panel != "", F.lower(panel) == panel).otherwise(a["lower"]), a["lower"], a["lower"], a["lower"], "lower"), pick(F.lit(False), F.lit(False), F.lit(True), F.lit(False), "dash"),
        (~(item | letter | dash | sep)).alias("done"), F.concat(a["out"], more).alias("out"),
    )
    return F.when(a["done"], a).otherwise(after)


def spec_items(spec: Column) -> Column:
    """array<struct<label, panels>> of what a text such as `1A-C, 2 and S3b` names, in order; panels are sorted capitals, none for a whole item.

    A dash between numbers fills what lies between, one between letters fills the panels.  A lower-case letter
    on its own ends the text, unless the last item with a panel has a lower-case one.  Null and empty name nothing.
    """
    start = F.struct(F.lit("").alias("label"), F.lit(None).cast("long").alias("number"), F.lit("").alias("panel"), F.lit(False).alias("lower"), F.lit(False).alias("dash"), F.lit(False).alias("done"), F.array().cast(_OUT).alias("out"))
    out = F.aggregate(F.transform(F.regexp_extract_all(F.coalesce(spec, F.lit("")), F.lit(TOKEN), F.lit(0)), _token), start, _step)["out"]
    panels = lambda o, label: F.array_sort(F.array_distinct(F.transform(F.filter(o, lambda x: (x["label"] == label) & (x["panel"] != "")), lambda x: x["panel"])))
    whole = lambda o: F.transform(F.array_distinct(F.transform(o, lambda x: x["label"])), lambda n: F.struct(n.alias("label"), panels(o, n).alias("panels")))
    return F.transform(F.array(out), whole).getItem(0)


# Legends


def _group(prefix: Column, label: Column) -> Column:
    return F.when(F.lower(prefix).contains("extended"), "extended").when((prefix != "") | F.upper(label).startswith("S"), "supplementary").otherwise("main")


def _kind(word: Column) -> Column:
    return F.when(F.lower(word).startswith("fig"), "figure").otherwise("table")


def _number(label: Column) -> Column:
    return F.regexp_replace(label, "[^0-9]", "").try_cast("int")


def runs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with `legend` (a legend begins here), `run` (the number of the run in its document) and `absorbed` (a legend before it holds it).

    A paragraph that looks like a legend but reads like an entry of a reference list (authors, a year, a DOI near its start, no
    panel and 400 characters at most) opens a run and is no legend.
    """
    text = F.coalesce("text", F.lit(""))
    head = F.left(text, F.lit(220))
    looks = text.rlike(LEGEND)
    entry = head.rlike(REFERENCE) & ~(head.contains("(A)") | head.contains("(a)") | (F.length(text) > 400))
    heading = F.coalesce("is_heading", F.lit(False))
    opens = heading | ~text.rlike(r"\S") | looks
    marked = paragraphs.select("doc_id", "idx", text.alias("text"), "section", (looks & ~entry & ~heading).alias("legend"), heading.alias("heading"), opens.alias("opens"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    numbered = marked.withColumn("run", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = Window.partitionBy("doc_id", "run").orderBy("idx")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.first("legend").over(whole) & F.nth_value(F.col("text").rlike(PANEL), 2).over(whole), F.lit(False))
    return numbered.withColumn("absorbed", held & ~F.col("opens"))


def panels_of(text: Column) -> Column:
    """The panels that a legend labels: bracketed letters, ranges and lists of them, and letters that open a sentence; only the run from A counts."""
    ranges = F.regexp_extract_all(text, F.lit(r"\(([A-Za-z]\s*[–—-]\s*[A-Za-z])\)"), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r"\(([A-Za-z](?:\s*,\s*[A-Za-z])*)\)"), F.lit(1))
    opening = F.regexp_extract_all(text, F.lit(r"(?:^|[.;:]\s+)([A-Z])[.)]\s"), F.lit(1))
    filled = F.flatten(F.transform(ranges, lambda r: _letters(F.upper(F.left(r, F.lit(1))), F.upper(F.right(r, F.lit(1))))))
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.upper(x), F.lit("[A-Z]"), F.lit(0))))
    found = F.array_distinct(F.concat(filled, listed, opening))
    letters = F.array(*[F.chr(F.lit(65 + k)) for k in range(26)])
    run = lambda f: F.filter(letters, lambda c, k: F.forall(F.slice(letters, F.lit(1), k + 1), lambda x: F.array_contains(f, x)))
    return F.transform(F.array(found), run).getItem(0)


def legends(told: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, grp, number, anchor, text, n_absorbed, panels): legends with the paragraphs that go on with them.

    told: of `runs`.  A table has no panels.
    """
    parts = told.where("legend or absorbed").groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"), F.min(F.when(F.col("legend"), F.col("idx"))).alias("idx"))
    rows = parts.where("idx is not null").select("doc_id", "idx", F.get("p", 0)["text"].alias("head"), F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"), (F.size("p") - 1).alias("n_absorbed"))
    part = lambda k: F.regexp_extract("head", LEGEND, k)
    kind = _kind(part(2))
    return rows.select(
        "doc_id", "idx", kind.alias("kind"), _group(part(1), part(3)).alias("grp"), _number(part(3)).alias("number"), F.trim(part(0)).alias("anchor"), "text", "n_absorbed",
        F.when(kind == "figure", panels_of(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("panels"),
    )


def callouts(told: DataFrame) -> DataFrame:
    """(doc_id, idx, start, seq, kind, grp, number, panels, short): what callouts outside legends, headings and the reference list name.

    told: of `runs`.  seq is an item's place in its callout; short is true for Fig. and Figs.
    """
    rows = told.where("not legend and not absorbed and not heading and section <> 'references'").where(F.col("text").rlike(CALLOUT))
    each = rows.select("doc_id", "idx", F.explode(matches(F.col("text"), CALLOUT)).alias("m"))
    part = lambda k: F.regexp_extract("m.text", CALLOUT, k)
    read = each.select("doc_id", "idx", "m.start", part(1).alias("prefix"), part(2).alias("word"), F.posexplode(spec_items(part(3))).alias("seq", "s"))
    short = F.lower("word").startswith("fig") & ~F.lower("word").startswith("figure")
    return read.select("doc_id", "idx", "start", "seq", _kind(F.col("word")).alias("kind"), _group(F.col("prefix"), F.col("s.label")).alias("grp"), _number(F.col("s.label")).alias("number"), F.col("s.panels").alias("panels"), short.alias("short"))


# Issues


def _made(code: str, severity: str, idx: Column, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), idx.cast("int").alias("idx"), detail.cast("string").alias("detail"))


def _items(told: DataFrame) -> DataFrame:
    """One row for each item of a document: its legends in order, its first callout, what it is cited for and the issues of the item alone."""
    held = legends(told).select("doc_id", "kind", "grp", "number", F.lit(True).alias("legend"), "idx", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("seq"), "panels", F.lit(False).alias("short"))
    named = callouts(told).select("doc_id", "kind", "grp", "number", F.lit(False).alias("legend"), "idx", "start", "seq", "panels", "short")
    both = held.unionByName(named).repartition("doc_id")  # all that follows lies within a document
    cited = F.when(~F.col("legend"), F.transform("panels", lambda p: F.struct(p.alias("panel"), F.col("idx").alias("idx"))))
    rows = both.groupBy("doc_id", "kind", "grp", "number").agg(
        F.array_sort(F.collect_list(F.when(F.col("legend"), F.struct("idx", "panels")))).alias("legends"), F.min(F.when(~F.col("legend"), F.struct("idx", "start", "seq"))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(cited)))).alias("cited"), F.count_if(~F.col("legend")).alias("n"), F.count_if("short").alias("n_short"),  # of one item of one document
    )
    label, own = F.concat_ws(" ", "kind", "grp", "number"), F.coalesce(F.get("legends", 0)["panels"], F.array().cast("array<string>"))
    used = F.array_distinct(F.transform("cited", lambda c: c["panel"]))
    idle = F.array_except(own, used)
    alone = F.concat(
        F.transform(F.slice("legends", F.lit(2), F.greatest(F.size("legends") - 1, F.lit(0))), lambda x: _made("duplicate_legend", "warning", x["idx"], label)),
        F.transform(F.filter("cited", lambda c: (F.size(own) > 0) & ~F.array_contains(own, c["panel"])), lambda c: _made("unknown_panel", "warning", c["idx"], F.concat(label, c["panel"]))),
        F.array_compact(F.array(F.when((F.size(used) > 0) & (F.size(idle) > 0), _made("panels_not_cited", "info", F.get("legends", 0)["idx"], F.concat(label, F.lit(" "), F.array_join(idle, ",")))))),
        F.array_compact(F.array(F.when((F.size("legends") > 0) & F.col("first").isNull(), _made("never_cited", "error", F.get("legends", 0)["idx"], label)))),
    )
    return rows.select("doc_id", "kind", "grp", F.struct("number", "first", F.get("legends", 0)["idx"].alias("legend")).alias("item"), "n", "n_short", alone.alias("alone"))


def issues(told: DataFrame) -> DataFrame:
    """Issues of figures and tables, each once.

    told: of `runs`.  Items, then the items of one kind and group, then documents are grouped inside a document's partition: an item cited without a legend
    is an error where its group has legends, and a main group without any is one info; numbering starts at 1 and has no gaps; an item is out of order if a
    smaller one that is cited is first named later.
    """
    group = _items(told).groupBy("doc_id", "kind", "grp").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("n").alias("n"), F.sum("n_short").alias("n_short"), F.flatten(F.collect_list("alone")).alias("alone"))
    label = lambda n: F.concat_ws(" ", F.col("kind"), F.col("grp"), n.cast("string"))
    held, cited = F.filter("items", lambda i: i["legend"].isNotNull()), F.filter("items", lambda i: i["first"].isNotNull())
    some, lacking = F.size(held) > 0, F.filter("items", lambda i: i["legend"].isNull())
    missing = F.when(some, F.transform(lacking, lambda i: _made("no_legend", "error", i["first"]["idx"], label(i["number"])))).when((F.col("grp") == "main") & (F.size(cited) > 0), F.array(_made("no_legends_at_all", "info", F.lit(None), F.concat_ws(" ", "kind", F.size(cited).cast("string")))))
    none = F.array().cast("array<struct<severity:string,code:string,idx:int,detail:string>>")

    def gaps(h):
        first = F.when((F.size(h) > 0) & (F.get(h, 0)["number"] != 1), F.array(_made("numbering", "warning", F.get(h, 0)["legend"], F.concat_ws(" ", F.col("kind"), F.col("grp"), F.lit("start"), F.get(h, 0)["number"].cast("string")))))
        jump = F.filter(F.transform(h, lambda x, k: F.when((k > 0) & (x["number"] - F.get(h, k - 1)["number"] > 1), _made("numbering", "warning", x["legend"], F.concat_ws(" ", F.col("kind"), F.col("grp"), F.get(h, k - 1)["number"].cast("string"), x["number"].cast("string"))))), lambda i: i.isNotNull())
        return F.concat(F.coalesce(first, none), jump)

    def late(c):
        later = lambda x: F.get(F.filter(c, lambda y: (y["number"] < x["number"]) & (y["first"] > x["first"])), 0)["number"]
        return F.filter(F.transform(c, lambda x: F.when(later(x).isNotNull(), _made("citation_order", "warning", x["first"]["idx"], F.concat_ws(" ", label(x["number"]), F.lit("before"), later(x).cast("string"))))), lambda i: i.isNotNull())

    both = F.concat("alone", F.coalesce(missing, none), F.transform(F.array(held), gaps).getItem(0), F.transform(F.array(cited), late).getItem(0))
    per = group.withColumn("made", both).groupBy("doc_id").agg(F.flatten(F.collect_list("made")).alias("made"), F.sum(F.when(F.col("kind") == "figure", F.col("n"))).alias("n"), F.sum(F.when(F.col("kind") == "figure", F.col("n_short"))).alias("short"))
    mixed = F.when((F.col("short") > 0) & (F.col("short") < F.col("n")), F.array(_made("mixed_names", "info", F.lit(None), F.concat_ws("/", "short", "n"))))
    rows = per.select("doc_id", F.explode(F.array_distinct(F.concat("made", F.coalesce(mixed, none)))).alias("i")).select("doc_id", "i.*")
    return rows.select("doc_id", F.lit("figures").alias("check"), "severity", "code", F.col("idx").alias("para_index"), "detail")
