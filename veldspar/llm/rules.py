"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned mask over those bits, so a changed
policy or an ablation reads the ledger and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Name and failing condition over the measurements; the place in the list is the bit.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("shouting", "2 * n_capitals > word_chars"),
    ("exclaiming", "2 * n_bangs > n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs"]


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, by name, under a version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {
    "base": Policy("1", ("few_words", "repeated_windows")),
    "standard": Policy("1", tuple(n for n, _ in RULES)),
}


def let(value: Column, body) -> Column:
    """body(value), with the value computed once even where body uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""

    def flagged(s):
        same = lambda k, e: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(k - 1, e) | same(k + 1, e)), lambda e: e["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spans = let(let(ordered, flagged), lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_total(spans))


def _windows(words: Column) -> Column:
    later = lambda i, j: F.get(words, i + j)
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    return F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(w, *[later(i, j) for j in range(1, WINDOW)]))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements).  A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    about = let(words, lambda ws: F.struct(F.size(ws).alias("n"), let(_windows(ws), _covered).alias("r")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    whole = F.length(text)
    long = lambda c: c.cast("long")
    first = docs.select(
        "doc_id", about.alias("w"), lines.alias("l"), _without(text, " \t\n\v\f\r").alias("word_chars"), (whole - _without(text, "#*$%&|<>")).alias("n_symbols"),
        (whole - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"), (whole - _without(text, "!")).alias("n_bangs"),
    )
    return first.select(
        "doc_id", long(F.col("w.n")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"), long(F.col("n_symbols")).alias("n_symbols"), long(F.col("l.n")).alias("n_lines"),
        long(F.col("l.d")).alias("n_dup_lines"), long(F.col("w.r")).alias("n_repeat_words"), long(F.col("n_capitals")).alias("n_capitals"), long(F.col("n_bangs")).alias("n_bangs"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `failed`, a long with bit i set if rule i fails.

    One row per row of docs, repeated rows and null ids included; an empty table gives none.
    Other columns of docs are not read.
    """
    bits = " + ".join(f"if({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES))
    return measure(docs).withColumn("failed", F.expr(bits))


def apply_policy(table: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept`, false if a rule of the policy failed."""
    return table.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(table: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): what each rule of a policy does alone.

    The ledger is first reduced to a count for each mask, of which there are few.
    """
    masks = table.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])
    each = masks.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.rule", "r.bit")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        some(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), some(F.col("m") == F.col("bit")).alias("n_only"), some(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without")
    )
