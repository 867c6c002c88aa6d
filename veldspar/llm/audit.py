"""Filter interaction audit by direct relational replay.

Every document gets one flag for each filter, from its text alone and from the table's other texts.  The flags of
all documents are crossed with the 120 orders of the five filters (a constant table, broadcast), five
steps are exploded, the first failure decides where a document goes, and conditional sums are combined on the map side.
Texts are read once; what is shuffled is an id, a 128-bit digest and a few bits.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import adaptive, hot_bar, save

BLANK = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: A document that fails nothing is kept after the last step.
NEVER = len(FILTERS) + 1


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _own_flags(text: Column) -> Column:
    """The bits of the filters that look at one text."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    counts = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("k"))).getItem(0)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    mark = lambda letter, failed: F.when(failed, F.lit(_bit(letter))).otherwise(F.lit(0))
    few = F.transform(F.array(counts), lambda c: mark("A", c["n"] < 50) + mark("B", F.lit(100).cast("long") * c["k"] < F.lit(65).cast("long") * c["n"])).getItem(0)
    return few + mark("C", F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text)) + mark("D", text.rlike("[#$%&*|]"))


def _with_first(slim: DataFrame) -> DataFrame:
    """Each row's `first`, the least doc_id of its text where the table holds the text twice or more; hot texts' rows stay where they are."""
    again = save(slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    bar = hot_bar(again)
    if bar is None:
        return slim.join(again.drop("n"), "digest", "left")
    hot = F.broadcast(again.where(F.col("n") > bar).drop("n"))  # HOT rows at most
    rest = slim.join(hot.select("digest"), "digest", "left_anti")
    return slim.join(hot, "digest").unionByName(rest.join(again.where(F.col("n") <= bar).drop("n"), "digest", "left"))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) for each row of docs, repeated rows included.

    part is the source, null as the empty string; failed has a bit for each filter that the document fails.  Null and
    blank texts have no words.  Filter E fails where a smaller doc_id has the same text; a null id is smaller than none
    and has none that is smaller.  good and toxic come from labels; of several labels for an id one that says 1
    decides, and without one both are false.
    """
    adaptive(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _own_flags(text).alias("failed"), F.unhex(F.md5(text)).alias("digest"))
    found = _with_first(save(slim, "flags"))
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(_bit("E"))).otherwise(F.lit(0))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    named = found.select("doc_id", "part", (F.col("failed") + copy).alias("failed")).join(known, "doc_id", "left")
    return named.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """(number, filter_order, bits): all orders of the filters with the bits in order."""
    rows = [(i, "".join(p), [_bit(x) for x in p]) for i, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "number int, filter_order string, bits array<int>")


def replay(flagged: DataFrame) -> DataFrame:
    """One row for each part, order and step: documents kept after it, removed, redundant, failing it alone, good and toxic ones lost, and its filter's shapley total.

    flagged: (part, failed, good, toxic).  shapley sums a filter's removals over all orders.  Counts of nothing are 0; an empty table has no part and no row.
    """
    every = orders(flagged.sparkSession)
    bits = [F.col("bits")[k] for k in range(len(FILTERS))]
    fails = lambda bit: F.col("failed").bitwiseAND(bit) != 0
    first = F.lit(NEVER)
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(bits[k]), F.lit(k + 1)).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("step"), b.alias("bit")) for k, b in enumerate(bits)]))
    crossed = flagged.crossJoin(F.broadcast(every.select("number", "bits"))).select("part", "number", "failed", "good", "toxic", first.alias("first"), steps.alias("s"))
    here = F.col("first") == F.col("step")
    total = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    counted = crossed.select("part", "number", "failed", "good", "toxic", "first", "s.step", "s.bit").groupBy("part", "number", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"), total(here).alias("removed"), total(fails(F.col("bit")) & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"), total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    named = counted.join(F.broadcast(every.select("number", "filter_order")), "number")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", letter)).alias("shapley"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT 'ABCDE'[i:i] AS x FROM range(1, 6) r(i)),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT part, good, toxic, fails, filter_order, step::INTEGER AS step, ascii(filter_order[step:step]) - 64 AS k, len(list_filter(range(1, step), lambda j: fails[ascii(filter_order[j:j]) - 64])) > 0 AS gone
      FROM (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL) z, o, range(1, 6) q(step)),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT s.part, filter_order, step, s.k, sum(CASE WHEN NOT gone AND NOT s.fails[k] THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND s.fails[k] THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND s.fails[k] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN s.fails[k] AND len(list_filter(s.fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND s.fails[k] AND s.good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND s.fails[k] AND s.toxic THEN n ELSE 0 END) AS toxic_lost
      FROM s JOIN m USING (part, good, toxic, fails) GROUP BY s.part, filter_order, step, s.k)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""
