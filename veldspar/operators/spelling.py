"""British and American spellings of the same words.

One pattern finds every word that may be one of either kind; a table of words, made from stems and endings by rule and broadcast,
says which family and side it belongs to.  Its size is fixed by the lists below, or by those that a caller gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import spans

from .manuscripts import issue

CHECK = "consistency"
#: Families by what sets the two forms apart: words, what is British, what is American, and endings.
RULES = [
    ("colour flavour favour labour vapour odour honour rumour humour tumour neighbour harbour", "our", "or", " s ed ing"),
    ("behaviour", "our", "or", " s al ally"),
    ("analyse catalyse hydrolyse paralyse", "yse", "yze", " s d r rs"),
    ("organise recognise characterise summarise normalise optimise minimise maximise standardise visualise hypothesise emphasise categorise colonise ionise oxidise polymerise randomise stabilise sterilise synthesise utilise immunise localise sensitise homogenise", "ise", "ize", " d s r rs"),
    ("organisation characterisation normalisation optimisation standardisation visualisation colonisation polymerisation randomisation stabilisation sterilisation utilisation immunisation localisation homogenisation", "isation", "ization", " s"),
    ("centre fibre litre metre titre", "re", "er", " s"),
    ("labelled modelled signalled channelled travelled cancelled tunnelled fuelled", "lled", "led", ""),
    ("labelling modelling signalling channelling travelling cancelling tunnelling fuelling", "lling", "ling", ""),
    ("haemoglobin haemorrhage haematology anaemia leukaemia ischaemia hypoglycaemia paediatric faecal caecum aetiology anaesthesia", "ae", "e", " s"),
    ("oestrogen oedema oesophagus foetus foetal diarrhoea", "oe", "e", " s"),
    ("sulphur sulphate sulphide", "ph", "f", " s"),
    ("grey", "ey", "ay", " s"),
    ("catalogue analogue dialogue", "ogue", "og", " s"),
    ("defence offence", "ence", "ense", " s"),
    ("ageing", "geing", "ging", ""),
    ("mould", "ould", "old", " s y"),
    ("aluminium", "ium", "um", ""),
    ("programme", "mme", "m", " s"),
    ("artefact", "efact", "ifact", " s"),
    ("judgement", "gement", "gment", " s"),
]


def table(rules: Iterable[tuple[str, str, str, str]] = tuple(RULES)) -> list[tuple[str, str, bool]]:
    """(word, family, british) of every form; a family is named by its British and American stems."""
    out = {}
    for words, british, american, endings in rules:
        for stem in words.split():
            other = american.join(stem.rsplit(british, 1))
            for end in endings.split(" ") if endings else [""]:
                for word, side in ((stem, True), (other, False)):
                    out.setdefault(word + end, (f"{stem}/{other}", side))
    return [(w, f, b) for w, (f, b) in out.items()]


def checked(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, own): documents with text outside the reference list, and whether any of it stands outside the front matter too."""
    return paragraphs.where("text <> '' and section <> 'references'").groupBy("doc_id").agg(F.max(F.col("section") != "front_matter").alias("own"))


def _name(text: Column, m: Column) -> Column:
    """Whether a match is a capitalised word inside a sentence, which keeps its own spelling."""
    before = F.rtrim(F.left(text, m["start"]))
    return m["text"].rlike("^[A-Z]") & (before != "") & ~before.rlike("[.!?:]$")


def _branches(words: list[str]) -> str:
    """A pattern for the beginnings of words that looks at each letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    if "" in by:
        return ""
    return "(?:" + "|".join(c + _branches(rest) for c, rest in sorted(by.items())) + ")"


def found(paragraphs: DataFrame, rules: Iterable[tuple[str, str, str, str]] = tuple(RULES)) -> DataFrame:
    """(doc_id, idx, start, word, family, british) of every word with two spellings, names aside.

    All with text is searched, headings too, but the reference list and the front matter; in a document that has nothing else the front matter as well.
    """
    words = table(tuple(rules))
    begins = sorted({w[:4] for w, _, _ in words})
    quick = "".join(f"[{''.join(re.escape(c) for c in sorted({w[k] for w in begins}))}]" for k in range(min(map(len, begins))))  # few places pass, before any look behind
    pattern = rf"(?i)(?={quick})(?<![\p{{L}}\p{{N}}_]){_branches(begins)}[a-z]*+(?![\p{{L}}\p{{N}}_])"  # a match begins like one of the words and is looked up whole
    text = F.col("text")
    rows = paragraphs.where((F.col("section") != "references") & text.rlike(pattern))
    some = rows.select("doc_id", "idx", (F.col("section") == "front_matter").alias("front"), F.explode(F.filter(spans(text, pattern), lambda m: ~_name(text, m))).alias("m"))
    known = F.broadcast(paragraphs.sparkSession.createDataFrame(words, "word string, family string, british boolean"))
    hits = some.select("doc_id", "idx", "front", "m.start", F.lower("m.text").alias("word")).join(known, "word")
    return hits.join(checked(paragraphs), "doc_id").where("not front or not own").select("doc_id", "idx", "start", "word", "family", "british")


def issues(hits: DataFrame) -> DataFrame:
    """A warning for each family that a document writes in the way it mostly doesn't: its commonest such word (the first of a tie) and how often.

    hits: of `found`.  As many of both is British; a document with one kind alone has no issue.
    """
    per = hits.groupBy("doc_id", "family", "british", "word").agg(F.count("*").alias("n"), F.min(F.struct("idx", "start")).alias("at"))
    side = lambda british: F.sum(F.when(F.col("british") == british, F.col("n")).otherwise(0)).over(Window.partitionBy("doc_id"))
    odd = per.repartition("doc_id").withColumns({"b": side(True), "a": side(False)}).where("a > 0 and b > 0 and british = (b < a)")
    best = odd.groupBy("doc_id", "family", "british").agg(F.sum("n").alias("times"), F.min(F.struct((-F.col("n")).alias("n"), "at", "word")).alias("m"), F.min("at").alias("at"))
    return issue(best.withColumn("idx", F.col("at.idx")), CHECK, "warning", "spelling", F.concat_ws(" ", F.col("m.word"), F.when(F.col("british"), "British").otherwise("American"), "times"))
