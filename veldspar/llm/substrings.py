"""Substring dedup by collinear chaining of shared k-mer seeds.

Words' K-mers are thinned to window minima (each WIDTH consecutive K-mers keep the least
hash), so equal stretches of K + WIDTH - 1 words share a seed.  Every document
that holds a seed links it to the least doc_id that holds it only, so links grow with the
places, not with their pairs.  (Of a seed's places in its first holder the first counts; in
later documents every place is linked to it, so each copy of a passage is found.)  For each pair of documents the matches are chained in order with a
Fenwick tree: a chain gains the words it covers and pays for gaps.  Chains are then
aligned word by word around and between their seeds, and the words of a document that earlier
text covers are merged to passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, as_bytes, chunks, fresh, hot_bar, mix, save, small_batches

K, WIDTH = 6, 10
#: Longest period, in words, of a stretch that is one seed as a whole.
LOOP = 8
#: Words of a passage, at least; of a chain that counts towards one; and bridged between chains.
PASSAGE, CHAIN, BRIDGE = 50, 16, 6
#: Chaining: words that a gap may have, and what each gap word costs.
REACH, COST = 40, 0.25
#: Aligned words that must be equal, as a share.
ALIKE = 0.8
#: A table of spans below this goes to all executors instead of the texts being dealt.
SMALL_ROWS = 200_000
#: Stretches that one copy of a text is asked for, about; a text that more chains ask for is copied.
CROWD = 1024


def _loops(g: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, K-mers, period) of stretches that repeat with a period of up to LOOP words.

    last: for each K-mer the place after its text's last one.  A loop starts at its period's
    least K-mer and its hash is of the period's K-mers in any rotation, so equal loops meet whatever
    their phase.
    """
    out = []
    for p in range(1, LOOP + 1):
        same = np.zeros(len(g) + 2, np.int8)
        if len(g) > p:
            same[1 : len(g) - p + 1] = (g[p:] == g[:-p]) & (last[:-p] == last[p:])
        step = np.diff(same)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - begin >= 2 * p
        begin, end = begin[long], end[long] + p
        if len(begin):
            turn = g[begin[:, None] + np.arange(p)]
            own = np.ones(len(begin), bool)
            for d in range(1, p):  # a shorter period's loop was found before
                own &= ~((p % d == 0) & (turn == np.roll(turn, d, axis=1)).all(axis=1))
            first = begin + turn.argmin(axis=1)
            # loops that are passages by themselves meet apart from shorter ones, which would hide them as first places
            kind = np.where(end - first + K - 1 >= PASSAGE, p + LOOP, p).astype(np.uint64)
            out.append((first[own], mix(turn.sum(axis=1, dtype=np.uint64) + kind)[own], (end - first)[own], np.full(own.sum(), p)))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *out))


#: K-mers of a loop, at most; a longer one counts as so long.
_WIDE = (1 << 24) - 1


def _seeds(batches):
    for (ids,), texts in chunks(batches):
        w = Words(texts, fold=True)
        at, g = w.grams(K)
        if not len(at):
            continue
        cut = np.searchsorted(at, w.ptr)
        n = len(g)
        # least hash of each run of WIDTH, over the whole chunk by doubling; runs across texts are not asked for
        value = (g & ~np.uint64(0xFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFF))
        run, size = value, 1
        while size < WIDTH:
            step = min(size, WIDTH - size)
            run = np.minimum(run[: len(run) - step], run[step:]) if len(run) > step else run[:0]
            size += step
        owner = np.repeat(np.arange(w.n), np.diff(cut))
        whole = np.flatnonzero(owner[: len(run)] == owner[WIDTH - 1 :]) if len(run) else np.zeros(0, np.int64)
        low = (run[whole] & np.uint64(0xFFFFF)).astype(np.int64)
        least = (whole & ~0xFFFFF) | low
        least[least < whole] += 1 << 20
        keep = np.zeros(n, bool)
        keep[least] = True
        for d in np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < WIDTH)):
            keep[cut[d] + np.argmin(value[cut[d] : cut[d + 1]])] = True
        some = np.flatnonzero(keep)
        loop, name, wide, period = _loops(g, np.repeat(cut[1:], np.diff(cut)))
        place, hash_ = np.concatenate([some, loop]), np.concatenate([g[some], name])
        span = np.concatenate([np.ones(len(some), np.int64), np.minimum(wide, _WIDE) | period << 24])
        order = np.lexsort((place, hash_, owner[place]))
        place, hash_, span = place[order], hash_[order], span[order]
        doc = owner[place]
        # a row for each text and seed: the first place, and the others if there are any
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])]))
        size = np.diff(np.append(first, len(place)))
        where = (span << 32) | (at[place] - w.ptr[doc])
        later = np.ones(len(place), bool)
        later[first] = False
        more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]), pa.int32(), mask=np.append(size == 1, False)), pa.array(where[later]))
        doc, hash_ = doc[first], hash_[first]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(where[first]), pa.array(hash_.view(np.int64)), more], names=["doc_id", "place", "gram", "more"])


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, place, gram, more) of the thinned K-mers and the loops of every whole text with an id, a row for each text and seed.

    place is the seed's first place, with the K-mers that it spans above bit 32 and a loop's period above bit 56; more has the other places or is null.
    """
    named = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    return as_bytes(named, "doc_id").mapInArrow(_seeds, "doc_id long, place long, gram long, more array<long>")


def chain(x: np.ndarray, y: np.ndarray, span: np.ndarray | int = 1) -> list[list[tuple[int, int, int, int]]]:
    """Chains of segments (x low, x high, y low, y high) of matches at places x and y, of K words and one more for each
    further K-mer that a seed spans.

    Runs on one diagonal are joined to segments first.  A segment's best chain value is its words
    plus the best earlier one that ends before it in both texts, less COST for each word of
    the gaps; the Fenwick tree holds those values (with the gap's share of the end added) as
    prefix maxima over y.  Chains are read back from the best end, each segment once.
    """
    by = np.lexsort((x, y - x))
    dx, dd = x[by], (y - x)[by]
    to = dx + np.broadcast_to(span, len(x))[by] + (K - 1)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(dd) != 0) | (np.diff(dx) > K + WIDTH)]))
    seg = sorted((int(a), int(b), int(a + d), int(b + d)) for a, b, d in zip(dx[cut], np.maximum.reduceat(to, cut), dd[cut]))
    if len(seg) == 1:
        return [seg]
    ends = sorted({s[3] for s in seg})
    rank = {e: i + 1 for i, e in enumerate(ends)}
    starts = np.searchsorted(ends, [s[2] for s in seg], side="right")
    tree = [(-np.inf, -1)] * (len(ends) + 1)
    value, back = [0.0] * len(seg), [-1] * len(seg)
    waiting = sorted(range(len(seg)), key=lambda i: seg[i][1])
    w = 0
    for i, (x0, x1, y0, y1) in enumerate(seg):
        while w < len(waiting) and seg[waiting[w]][1] <= x0:
            j = waiting[w]
            put = (value[j] + COST * (seg[j][1] + seg[j][3]), j)
            k = rank[seg[j][3]]
            while k <= len(ends):
                tree[k] = max(tree[k], put)
                k += k & -k
            w += 1
        best, k = (-np.inf, -1), int(starts[i])
        while k:
            best = max(best, tree[k])
            k -= k & -k
        value[i] = float(x1 - x0)
        gain = best[0] - COST * (x0 + y0)
        if best[1] >= 0 and gain > 0 and max(x0 - seg[best[1]][1], y0 - seg[best[1]][3]) <= REACH:
            value[i] += gain
            back[i] = best[1]
    used, out = [False] * len(seg), []
    for i in sorted(range(len(seg)), key=lambda i: (-value[i], i)):
        if used[i]:
            continue
        parts = []
        while i >= 0 and not used[i]:
            used[i] = True
            parts.append(seg[i])
            i = back[i]
        out.append(parts[::-1])
    return out


def _chained(batches):
    """Rows sorted by (doc, rep, pos, rep_pos, span) to chains; a group may go on in the next batch."""
    held: list[np.ndarray] = []

    def close(rows):
        out = []
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0), [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            x, y, n = rows[a:b, 2], rows[a:b, 3], rows[a:b, 4]
            out += [(rows[a, 0], rows[a, 1], c[0][0], c[-1][1], c[0][2], c[-1][3], [v for s in c for v in s]) for c in chain(x, y, n) if c[-1][1] - c[0][0] >= CHAIN - K]
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "rep", "x0", "x1", "y0", "y1", "parts"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        if held and (held[-1][-1, :2] != rows[-1, :2]).any() or not held:
            rows = np.concatenate([*held, rows]) if held else rows
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = [rows[cut:]]
            if cut:
                yield close(rows[:cut])
        else:
            held.append(rows)
    if held:
        yield close(np.concatenate(held))


def _salted(found: DataFrame, first: DataFrame) -> DataFrame:
    """Seeds and their first holders; a seed that very many texts hold is dealt by text to several copies of its holder's row."""
    bar = hot_bar(first)
    if bar is None:
        return found.join(first.drop("n"), "gram")
    copies = F.ceil(F.col("n") / bar)
    hot = F.broadcast(first.where(F.col("n") > bar).select("gram", copies.alias("copies")))  # common.HOT rows at most
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("copies")), F.lit(0))
    dealt = found.join(hot, "gram", "left").withColumn("salt", salt).drop("copies")
    return dealt.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n"), ["gram", "salt"]).drop("salt")


def chains(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, x0, x1, y0, y1, parts): words x0 to x1 of a document match y0 to y1 of an earlier one, by segments."""
    found = seeds(docs)
    low, wide, period = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftright(c, 32).bitwiseAND(F.lit(_WIDE)), lambda c: F.shiftright(c, 56)
    first = found.groupBy("gram").agg(F.min("doc_id").alias("rep"), F.min_by("place", F.struct("doc_id", low("place"))).alias("rep_place"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = save(first.where("rep <> last").drop("last"), "firsts")
    joined = _salted(found, first).where("doc_id <> rep")
    places = F.when(F.col("more").isNull(), F.array("place")).otherwise(F.concat(F.array("place"), F.col("more")))
    each = joined.select("doc_id", "rep", low("rep_place").alias("rep_pos"), wide("rep_place").alias("rep_wide"), F.explode(places).alias("place"))
    each = each.select("doc_id", "rep", "rep_pos", "rep_wide", low("place").alias("pos"), wide("place").alias("wide"), period("place").alias("period"))
    # where the first holder's loop is a passage by itself, a longer loop holds it again and again, and once more at its end
    again = (F.col("period") > 0) & (F.col("wide") >= F.col("rep_wide") + F.col("period")) & (F.col("rep_wide") >= PASSAGE - K + 1)
    step = F.col("rep_wide") - F.col("rep_wide") % F.col("period")
    last = F.col("wide") - F.col("rep_wide")
    turns = F.when(again, F.concat(F.sequence(F.lit(0).cast("long"), last, F.when(again, step).otherwise(1)), F.array(last - last % F.col("period")))).otherwise(F.array(F.lit(0).cast("long")))
    placed = each.select("doc_id", "rep", "rep_pos", "rep_wide", "pos", "wide", F.explode(turns).alias("turn"))
    links = placed.select("doc_id", "rep", (F.col("pos") + F.col("turn")).alias("pos"), "rep_pos", F.least(F.col("wide") - F.col("turn"), "rep_wide").alias("span"))
    return links.repartition("doc_id").sortWithinPartitions("doc_id", "rep", "pos", "rep_pos", "span").mapInArrow(_chained, "doc_id long, rep long, x0 long, x1 long, y0 long, y1 long, parts array<long>")


def _texts_with(docs: DataFrame, per_doc: DataFrame, rows: int, how: str) -> DataFrame:
    """Join texts and a table with few rows for each document; only a table of checked size is broadcast."""
    return docs.join(F.broadcast(per_doc) if rows <= SMALL_ROWS else per_doc, "doc_id", how)


#: Words beside a chain over which it may grow.
_MARGIN = 64


def _cut(batches):
    """The asked stretches of each text as 16-bit word hashes."""

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], names=["chain", "own", "lead", "words"])

    for (asked,), texts in chunks(batches):
        w = Words(texts, fold=True)
        small = (w.hash >> np.uint64(48)).astype("<u2")
        out, size = [], 0
        for d, wants in enumerate(asked.to_pylist()):
            begin, n = w.ptr[d], w.counts[d]
            for want in wants:
                low, high = max(0, want["low"] - _MARGIN), min(n, want["high"] + _MARGIN)
                out.append((want["chain"], want["own"], want["low"] - low, small[begin + low : begin + high].tobytes()))
                size += len(out[-1][3])
                if size > CHUNK_BYTES:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit of one integer for each word of a."""
    places: dict[int, int] = {}
    for i, v in enumerate(a):
        places[v] = places.get(v, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for v in b:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches have in common, in order."""
    same = int((a == b).sum()) if len(a) == len(b) else 0
    return same if same >= 0.97 * max(len(a), len(b)) else max(same, common_words(a.tolist(), b.tolist()))


def pieces(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start, stop, other start, other stop, alike) of the stretches of a chain that align.

    Gaps between segments are aligned word by word; a long gap of which less than half agrees
    cuts the chain there.  Ends grow over equal words.
    """
    runs: list[list] = []
    for i, j, p, q in parts:
        same = _equal(a[i:j], b[p:q])
        if runs:
            run = runs[-1]
            wide = max(i - run[1], p - run[3])
            common = _equal(a[run[1] : i], b[run[3] : p])
            if wide <= K + 2 or 2 * common >= wide:
                run[1], run[3], run[4] = j, q, run[4] + same + common
                continue
        runs.append([i, j, p, q, same])
    out = []
    for i, j, p, q, same in runs:
        while i and p and a[i - 1] == b[p - 1]:
            i, p, same = i - 1, p - 1, same + 1
        while j < len(a) and q < len(b) and a[j] == b[q]:
            j, q, same = j + 1, q + 1, same + 1
        size = max(j - i, q - p)
        if same >= ALIKE * size:
            out.append((i, j, p, q, same / size))
    return out


def _align(batches):
    for batch in batches:
        out = []
        for doc, rep, x0, y0, parts, lead, words, rep_lead, rep_words in zip(*(c.to_pylist() for c in batch.columns)):
            dx, dy = x0 - lead, y0 - rep_lead
            segs = [(parts[k] - dx, parts[k + 1] - dx, parts[k + 2] - dy, parts[k + 3] - dy) for k in range(0, len(parts), 4)]
            out += [(doc, rep, i + dx, j + dx, p + dy, q + dy, alike) for i, j, p, q, alike in pieces(np.frombuffer(words, "<u2"), np.frombuffer(rep_words, "<u2"), segs)]
        cols = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "rep", "start", "stop", "rep_start", "rep_stop", "alike"])


def differing(docs: DataFrame) -> DataFrame | None:
    """(doc_id, least): ids with more than one text, and the least hash among them; null where there is none."""
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    odd = save(hashed.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").drop("most"), "differing")
    n = odd.count()
    return None if not n else F.broadcast(odd) if n <= SMALL_ROWS else odd


def one_text(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    """The rows of docs but those whose id stands beside a text of a lesser hash, too."""
    if odd is None:
        return docs
    name = fresh(docs, "other")
    keyed = odd.select(F.col("doc_id").alias(name), F.col("least").alias(f"{name}_least"))
    joined = docs.join(keyed, F.col("doc_id").cast("long") == F.col(name), "left").where(F.col(name).isNull() | (F.xxhash64("text") == F.col(f"{name}_least")))
    return joined.select(*docs.columns)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, start, stop, rep_start, rep_stop, alike): aligned chains of CHAIN words or more.  An id has one text here."""
    found = save(chains(docs).withColumn("chain", F.monotonically_increasing_id()), "chains")
    asks = lambda doc, low, high, own: found.select(F.col(doc).alias("doc_id"), F.struct("chain", F.lit(own).alias("own"), F.col(low).alias("low"), F.col(high).alias("high")).alias("want"))
    wants = asks("doc_id", "x0", "x1", True).unionByName(asks("rep", "y0", "y1", False))
    # a document whose stretches a third of all others share is asked for each of them: such wants are dealt to copies of its text
    crowds = save(wants.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowds")
    crowds = F.broadcast(crowds) if crowds.count() <= SMALL_ROWS else crowds
    copy = F.coalesce(F.pmod(F.xxhash64("want.chain"), F.ceil(F.col("n") / (CROWD // 2))), F.lit(0))
    per_doc = wants.join(crowds, "doc_id", "left").groupBy("doc_id", copy.alias("copy")).agg(F.collect_list("want").alias("wants")).drop("copy")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = as_bytes(_texts_with(named, per_doc, found.count(), "inner"), "wants").mapInArrow(_cut, "chain long, own boolean, lead int, words binary")
    both = cut.groupBy("chain").agg(*[F.first(F.when(F.col("own") == own, F.col(c)), True).alias(n) for own, c, n in ((True, "lead", "lead"), (True, "words", "words"), (False, "lead", "rep_lead"), (False, "words", "rep_words"))])
    ready = found.join(both, "chain").select("doc_id", "rep", "x0", "y0", "parts", "lead", "words", "rep_lead", "rep_words")
    return ready.mapInArrow(_align, "doc_id long, rep long, start long, stop long, rep_start long, rep_stop long, alike double").where(F.col("stop") - F.col("start") >= CHAIN)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, others array<long>, alike): passages that earlier documents hold.

    A passage is a stretch of PASSAGE words or more that aligned chains cover, BRIDGE words
    apart at most; `others` are the ids it is matched with, the first holders; `alike` is the
    least share of equal words among its chains.  Words are runs of digits, letters and anything
    beyond ASCII, lower-cased, from 0.  Null and short texts give no row; rows with a null
    id can't be named and give none; repeated rows of one id count once, and of different texts of one id
    the one with the least hash is the document.
    """
    return _passages(one_text(docs, differing(docs)))


def _passages(docs: DataFrame) -> DataFrame:
    spans = matches(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "rep", "alike"))).alias("s"))  # of one document
    merged = F.expr(f"""aggregate(s, cast(array() as array<struct<start: bigint, stop: bigint, others: array<bigint>, alike: double>>), (acc, x) ->
        if(size(acc) > 0 and x.start <= element_at(acc, -1).stop + {BRIDGE},
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop,
                  array_union(element_at(acc, -1).others, array(x.rep)) as others, least(element_at(acc, -1).alike, x.alike) as alike))),
           concat(acc, array(struct(x.start as start, x.stop as stop, array(x.rep) as others, x.alike as alike)))))""")
    each = spans.select("doc_id", F.explode(merged).alias("p")).where(F.col("p.stop") - F.col("p.start") >= PASSAGE)
    return each.select("doc_id", F.col("p.start").alias("start_word"), F.col("p.stop").alias("end_word"), (F.col("p.stop") - F.col("p.start")).alias("n_words"), F.array_sort("p.others").alias("others"), F.col("p.alike").alias("alike"))


def _trim(schema, name):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            whole = batch.column("text").to_pylist()
            cuts = batch.column(name).to_pylist()
            keep = np.ones(len(texts), bool)
            for i, (t, c) in enumerate(zip(texts, cuts)):
                if c and t:
                    w = Words([t], fold=True, hashes=False)
                    left, at = [], 0
                    for a, b in sorted((x["start_word"], x["end_word"]) for x in c):
                        if a < len(w.start):
                            left.append(t[at : w.start[a]])
                            at = int(w.stop[min(b, len(w.start)) - 1])
                    rest = b"".join([*left, t[at:]])
                    keep[i] = bool(np.count_nonzero(Words([rest], hashes=False).norm))
                    whole[i] = rest.decode("utf-8", "replace")
            cols = [pa.array(whole, pa.string()) if f == "text" else batch.column(f) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, names=schema).filter(pa.array(keep))

    return run


def trim(docs: DataFrame) -> DataFrame:
    """The documents without the passages that earlier ones hold; one that loses its last word goes.

    Every passage stays in the document of least id that holds it.  n_chars, if there, is counted anew.
    Rows with a null id, and further texts of one id, stay as they are.
    """
    small_batches(docs.sparkSession)
    odd = differing(docs)
    found, name = save(_passages(one_text(docs, odd)), "passages"), fresh(docs, "cuts")
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias(name))
    joined = _texts_with(docs, per_doc, found.count(), "left")
    if odd is not None:
        least = fresh(docs, "least")
        joined = joined.join(odd.select("doc_id", F.col("least").alias(least)), "doc_id", "left").withColumn(name, F.when(F.col(least).isNull() | (F.xxhash64("text") == F.col(least)), F.col(name)))
    joined = joined.select(*docs.columns, name)
    out = joined.mapInArrow(_trim(docs.columns, name), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
