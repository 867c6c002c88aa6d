"""A prefix trie of conversations by smallest-member ownership.

Every distinct sequence of first turns is a node; the conversations that start with it are its
members, and its owner is the least of them.  Members of a node are members of its parent, so the nodes
that a conversation owns are a suffix of its own path, and it is enough to know where that suffix begins.
One row for each turn therefore carries all that a node's subtree needs: words that its conversation
doesn't own (occurrences less owned words are the words saved), whether it owns the next node (each child has
one owner) and whether it owns a leaf.  Sums over equal prefixes, combined before the shuffle, make the trie.

A prefix is known by its depth and two 64-bit sums (exclusive or) over hashes of its places and turns, so
texts never leave their first task.  Nodes with very many children or ends are not gathered: parents are
joined by `join_counted`, and ids of ends travel in blocks that one task hashes as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import adaptive, join_counted, save, small_batches

WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]
#: Ids of one block of ends are alike but for this many low bits.
BLOCK_BITS = 16


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, words): the turns in order, i from 0, without their texts.

    Turns are ordered by `turn`, null first; ties by the digest of role and text, so repeated rows stay and
    any order of the input gives the same.  Null roles and texts are empty.  Rows without a conv_id
    belong to no conversation and are left out.  Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.md5(role), F.md5(text))))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return slim.select("conv_id", (F.row_number().over(order) - 1).alias("i"), "digest", "words")


def with_shared_starts(turns: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """The turns of rebuilt conversations: the first h of the family's head, then a conversation's own after its first h.

    The head of conversation c is c - c % family (the remainder has c's sign); h is the unsigned crc32 of c in decimal, modulo most + 1.
    A head that is missing or short gives what it has.  A conversation may end up without turns, so
    each has a row with i = -1 and no digest that marks its start.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    each = turns.where("i = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head"))
    heads = turns.where((F.col("i") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("head"), "i", "digest", "words")
    taken = each.join(heads, "head").where("i < h").select("conv_id", "i", "digest", "words")
    return _starts(turns).unionByName(turns.where(F.col("i") >= h)).unionByName(taken)


def as_they_are(turns: DataFrame) -> DataFrame:
    """The turns of conversations that share nothing but what they say, with the rows that mark their starts."""
    return _starts(turns).unionByName(turns)


def _starts(turns: DataFrame) -> DataFrame:
    return turns.where("i = 0").select("conv_id", F.lit(-1).alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))


def _paths(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: its prefix (a, b), the one above (pa, pb), the last turn's words and whether there are more turns."""
    order = Window.partitionBy("conv_id").orderBy("i")
    lane = lambda k: F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "digest"))
    placed = turns.select("conv_id", "i", "digest", "words", (F.row_number().over(order) - 1).alias("depth"), F.lead("i").over(order).isNotNull().alias("more"))
    hashed = placed.select("conv_id", "i", "depth", "words", "more", lane(1).alias("x"), lane(2).alias("y"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hashed.select("conv_id", "depth", "words", "more", "x", "y", F.expr("bit_xor(x)").over(upto).alias("a"), F.expr("bit_xor(y)").over(upto).alias("b"))
    return sums.select("conv_id", "depth", "words", "more", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined by commas."""
    key, state, out = None, None, []

    def batch():
        d, a, b, h = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], names=[*NODE, "ends_sha256"])

    for x in batches:
        for *now, piece in zip(*(c.to_pylist() for c in x.columns)):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(piece)
        if len(out) > 10_000:
            yield batch()
            out.clear()
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch()


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end; a group holds a block of ids at most."""
    small_batches(paths.sparkSession)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = paths.where("not more").groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(ids, ",").cast("binary").alias("piece"))
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "piece")
    return ordered.mapInArrow(_hashed, "depth int, a long, b long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node, the root with depth 0 first of all; its owner (conv_id) and depth name it.

    turns: (conv_id, i, digest, words) with starts, as of `as_they_are` or `with_shared_starts`.
    conv_id is the least member, parent_conv_id the parent's (null for the root), n_convs the members, n_children
    the children, n_leaves the childless nodes of the subtree, saved_tokens the words that storing each node of
    the subtree once saves, ends_sha256 the digest of the comma-joined ids of members that end there.
    Repeated conversations are members of the same nodes; an empty table has no node.
    """
    adaptive(turns.sparkSession)
    paths = save(_paths(turns), "paths")
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("more").alias("inner"))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max((~F.col("inner")).cast("long")).alias("leaf"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.coalesce(F.col("depth") >= F.col("first"), F.lit(False))
    child = F.col("more") & F.coalesce(F.col("depth") + 1 >= F.col("first"), F.lit(False))
    marked = paths.join(owned, "conv_id", "left").select(
        "conv_id", *NODE, "pa", "pb", F.when(own, F.col("first")).alias("first"), child.cast("long").alias("child"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.sum(F.when(own, F.lit(0)).otherwise(F.col("words"))).over(up).alias("saved"),
    )
    made = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("first").alias("first"), F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    made = save(made, "nodes")
    return _named(made).join(_ends(paths), NODE, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def _named(made: DataFrame) -> DataFrame:
    """The nodes with their parents' owners: their own owner's, but where its suffix begins."""
    inside = made.where("depth > first or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    key = lambda d, a, b: F.struct(d.alias("depth"), F.col(a).alias("a"), F.col(b).alias("b")).alias("node")
    tops = made.where("depth = first and depth > 0").select("*", key(F.col("depth") - 1, "pa", "pb"))
    parents = made.where("n_children > 0").select(key(F.col("depth"), "a", "b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    return inside.unionByName(join_counted(tops, parents, "node").drop("node"))


#: crc32 of a decimal number: eight steps for each byte of its text.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda s, x:
  list_reduce(list_prepend(xor(s, x), list_transform(range(8), lambda k: 0::UBIGINT)), lambda u, k: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))), 4294967295::UBIGINT)"""

SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) - 1 AS i, role, text FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN n ON n.conv_id = c.head WHERE i < h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN n ON n.conv_id = c.conv_id WHERE i >= h),
p AS (SELECT c.conv_id, coalesce(path, []) AS path, coalesce(words, []) AS words FROM c LEFT JOIN (
        SELECT conv_id, list(md5(role) || md5(text) ORDER BY i) AS path, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY i) AS words FROM r GROUP BY conv_id) USING (conv_id)),
o AS (SELECT conv_id, path, words, unnest(range(0, len(path) + 1)) AS d FROM p),
x AS (SELECT path[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN words[d] ELSE 0 END) AS w,
             bool_and(len(path) = d) AS leaf, coalesce(string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM o GROUP BY path[1:d], d),
y AS (SELECT node, depth, n_convs, w, leaf, unnest(range(0, depth + 1)) AS above FROM x),
s AS (SELECT node[1:above] AS node, above AS depth, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE depth = above + 1) AS n_children FROM y GROUP BY node[1:above], above)
SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.node = x.node LEFT JOIN x u ON u.depth = x.depth - 1 AND u.node = x.node[1:x.depth - 1]
"""
