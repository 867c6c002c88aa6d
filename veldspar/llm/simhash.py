"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint is eight bytes.  Two fingerprints that differ in at most two bits share
at least six of the eight positional bytes, the guaranteed minimum.  Postings of a single
byte have only 2048 lists and so would grow with the square of the corpus; a posting here is
keyed by four positional bytes.  The fourteen choices of four positions are those whose numbers
XOR to zero, a Steiner system: of them, two fingerprints that share exactly five bytes share one, with six bytes three,
with seven bytes seven.  So the number of postings that a pair shares says whether it shares six bytes: pairs are
counted over all postings, those below the minimum go, and the rest are verified bit by bit.

A posting longer than `crowd` (near copies in thousands) emits no pairs: its
fingerprints name themselves and their 64 one-bit neighbours as hubs.  Two
fingerprints share a hub exactly if they differ in at most two bits, and a hub has at most
65 distinct members, so each links to the least of them.  Both ways are exact: a pair that meets in a crowded posting
is linked by its hub, and any other pair's count is whole.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, forget, join_counted, save, segment_sums, stored
from .components import components

SEED = 42
_v = np.arange(256, dtype=np.uint64)
#: Bit i of a byte in lane i of eight 8-bit lanes.
_LANES = sum((((_v >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8)), np.zeros(256, np.uint64))


def _stretches(text: bytes, width: int, most: int):
    """A long text in stretches that end between words and begin width - 1 words before the last one's end."""
    space = re.compile(rb"[ \t-\r]+(?=[^ \t-\r])")
    low, begun = 0, b""
    while len(text) - low > most and (cut := space.search(text, low + most)):
        some = begun + text[low : cut.end()]
        yield some
        begun = b" ".join(some.rsplit(None, width - 1)[1 - width :]) + b" " if width > 1 else b""
        low = cut.end()
    yield begun + text[low:]


def fingerprints_of(texts: list[bytes], width: int = 3, long: int = 8 << 20) -> np.ndarray:
    """A signed 64-bit fingerprint for each text; 0 where there is no word."""
    out = _short([b"" if len(t) > long else t for t in texts], width)
    for i, t in enumerate(texts):
        if len(t) > long:
            out[i] = _long(t, width, long // 4)
    return out


def _hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(0, len(words) - width + 1))


def _long(text: bytes, width: int, most: int) -> int:
    """The fingerprint of one text, counted a stretch at a time."""
    if len(text.split(None, width)) < width:
        return int(_short([text], width)[0])
    n, ones = 0, np.zeros(64, np.int64)
    for some in _stretches(text, width, most):
        h = _hashes(some, width)
        n += len(h)
        ones += [np.count_nonzero(h >> np.uint64(b) & np.uint64(1)) for b in range(64)]
    value = sum(1 << b for b in range(64) if 2 * ones[b] > n)
    return value - (1 << 64 if value >> 63 else 0)


def _short(texts: list[bytes], width: int) -> np.ndarray:
    parts, sizes = [], []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
        n = len(words)
        if n == 0:
            sizes.append(0)
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if n >= width else [b" ".join(words)]
        m = max(1, n - width + 1)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, m))
        sizes.append(m)
    out = np.zeros(len(texts), np.uint64)
    if parts:
        sizes = np.array(sizes)
        full = np.flatnonzero(sizes)
        m = sizes[full]
        per = -(-m // 255)  # runs of at most 255 hashes fit the lanes
        first = np.concatenate([[0], np.cumsum(m)[:-1]])
        runs = np.concatenate([[0], np.cumsum(per)])
        begin = np.repeat(first - 255 * runs[:-1], per) + 255 * np.arange(runs[-1])
        bytes_ = np.concatenate(parts).view(np.uint8).reshape(-1, 8)
        value = np.zeros(len(full), np.uint64)
        for j in range(8):
            lanes = np.add.reduceat(_LANES[bytes_[:, j]], begin).view(np.uint8).reshape(-1, 8)
            over = 2 * segment_sums(lanes, runs) > m[:, None]
            value |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
        out[full] = value
    return out.view(np.int64)


def _map(batches):
    for (ids,), texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(fingerprints_of(texts))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every whole text; a null or empty text has fingerprint 0."""
    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(_map, "doc_id long, fp long")


#: Choices of four byte positions; any three positions are in exactly one.
POSITIONS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Postings shared by two fingerprints that share so many positional bytes, at least.
SHARED = {8: len(POSITIONS), 7: 7, 6: 3}


def links(prints: DataFrame, bits: int = 2, crowd: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose graph has exactly the wanted components.

    prints: distinct non-null values in column fp.  bits may be 0, 1 or 2.
    """
    if bits not in (0, 1, 2):
        raise ValueError("bits must be 0, 1 or 2")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))
    keys = [F.lit(k << 32) + sum((F.shiftleft(byte(i), 8 * j) for j, i in enumerate(c)), F.lit(0)) for k, c in enumerate(POSITIONS)]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings, path = stored(postings.join(sizes, "key"), "postings")
    few = postings.where(F.col("n") <= crowd)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))
    light = met.where((F.col("shared") >= SHARED[8 - bits]) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    many = postings.where(F.col("n") > crowd).select("fp").distinct()
    if bits < 2:  # within one bit: the fingerprint or one neighbour is the other's hub only when it exists itself
        hubs = many.select("fp", F.explode(F.array(*([F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64 * bits)]))).alias("hub"))
        heavy = hubs.join(many.select(F.col("fp").alias("hub")), "hub").where("hub < fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    else:
        hubs = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])).alias("hub"))
        heavy = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    out, _ = stored(light.unionByName(heavy).distinct(), "links")
    forget(prints.sparkSession, path)
    return out


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable through links of at most `bits` differing
    bits.  Repeated rows stay repeated; texts without words share fingerprint zero and are
    linked like any other; a null doc_id keeps its row and is never a component's id, so a
    component of nulls alone has a null id.  An empty table gives no row.
    """
    prints = save(fingerprints(docs), "fingerprints")
    own = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    edges = links(own.select("fp"), bits)
    roots = components(edges, "a", "b")
    grouped = own.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = save(grouped.join(named, "root").select("fp", "component_id", "n"), "labels")
    return join_counted(prints, labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 2) -> DataFrame:
    """The documents whose id is their component's id: one of each group stays.

    Of repeated rows with that id one stays; rows with a null id are kept as they are,
    since nothing can name them.
    """
    groups = near_duplicates(docs, bits).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    first = named.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))
