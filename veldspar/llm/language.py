"""Language identification by interpolated Kneser-Ney character models.

A text's letters are lower-cased and every run of other characters is one blank.  For
each language the counts of four-character grams over all training texts give a
Kneser-Ney model: raw counts at the highest order, numbers of distinct contexts
below, one absolute discount for each order, and an even share at the bottom.  Spark computes the
probability of every gram seen at each order, and the weight that each context leaves to the order below.

The models go out in blocks of about BLOCK rows, as sorted arrays (gram, value): one language's rows
are dealt by the two middle letters of a gram, which all look-ups of a gram share (those of the two lowest orders by the
letter before the last), so each gram's cost comes from one block of each kind.  The driver fetches one block at a
time, and a worker holds one at a time once all of them exceed HELD bytes; it then scores larger groups of texts for
each round of blocks.  A text gets the language of least cross-entropy a character; it is marked rejected where
that is beyond what the training texts of the language show (a high quantile over all of them).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLAB, as_bytes, chunks, save

#: Four symbols of 16 bits are a gram.  0 stands between texts, 32 for anything but a letter.
ORDER = 4
#: Rows of the models in one block, about, and bytes of blocks that a worker keeps.
BLOCK, HELD = 1_000_000, 64 << 20
#: Symbols that are scored together for each round of blocks when they aren't kept.
GROUP = 16 << 20
#: Steps of a unit of cross-entropy that the rejection tells apart, so that a language has a bounded number of different values.
STEPS = 4096
_fold: list[np.ndarray] = []


def folding() -> np.ndarray:
    """Symbol of every code point: lower-cased letter, or 32.

    Letters beyond U+FFFF share symbols with others above 0x7FFF (their last 15 bits count), so a
    few rare scripts and ideographs are taken for each other.
    """
    if not _fold:
        table = np.full(0x110000, 32, np.uint16)
        for c in range(1, 0x20000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                x = ord(low) if len(low) == 1 else c
                table[c] = x if x < 0x10000 else 0x8000 | x & 0x7FFF
        table[0x20000:0x32000] = (np.arange(0x20000, 0x32000) & 0x7FFF) | 0x8000
        table[0] = 0
        _fold.append(table)
    return _fold[0]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk with three zeros before each text, and each text's first place (and the end)."""
    strings = [t.decode("utf-8", "replace").replace("\0", " ") for t in texts]
    joined = "\0\0\0" + "\0\0\0".join(strings)
    edge = np.cumsum([0, *[len(t) + 3 for t in strings]])
    kept, place, size, before = [], np.zeros(len(edge), np.int64), 0, 0
    for low in range(0, len(joined), SLAB):
        s = folding()[np.frombuffer(joined[low : low + SLAB].encode("utf-32-le"), np.uint32)]
        keep = (s != 32) | (np.concatenate([[before], s[:-1]]) != 32)
        inside = (edge >= low) & (edge <= low + len(s))
        place[inside] = size + np.concatenate([[0], np.cumsum(keep)])[edge[inside] - low]
        before = s[-1]
        kept.append(s[keep])
        size += len(kept[-1])
    return np.concatenate(kept), place


def grams(s: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol but the zeros, from place low to high, and the symbol's place."""
    at = np.flatnonzero(s[low:high]) + low
    w = [s[at - k].astype(np.uint64) << np.uint64(16 * k) for k in range(ORDER)]
    return w[0] | w[1] | w[2] | w[3], at


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def _get(table: tuple[np.ndarray, np.ndarray], want: np.ndarray, otherwise: float = 1.0) -> np.ndarray:
    at, seen = _find(table[0], want)
    return np.where(seen, table[1][at], otherwise) if len(table[0]) else np.full(len(want), otherwise)


_NONE = (np.zeros(0, np.uint64), np.zeros(0))
#: What a row of a model holds: the probability of a gram at an order, or the weight a context of that order leaves to the one below.
_CHANCE, _WEIGHT = {k: k for k in range(1, ORDER + 1)}, {k: 10 + k for k in range(1, ORDER + 1)}


def _low(x, bits: int):
    return x & np.uint64((1 << bits) - 1)


@dataclass
class Languages:
    names: list[str]
    parts: list[tuple[int, int]] = field(default_factory=list)  # of each language: parts of the higher two orders, of the lower two
    where: dict[tuple[int, bool, int], int] = field(default_factory=dict)  # (language, higher, part): block
    blocks: list[Broadcast] = field(default_factory=list)
    size: int = 0  # bytes of all blocks
    limit: np.ndarray | None = None  # of cross-entropy, for each language

    def unit(self, k: int, higher: bool, part: int) -> dict:
        """The arrays of one part; other blocks are dropped if not all may stay."""
        b = self.where.get((k, higher, part))
        if b is None:
            return {}
        if self.size > HELD:
            for other in self.blocks[:b] + self.blocks[b + 1 :]:
                other.__dict__.pop("_value", None)
        return self.blocks[b].value.get((k, higher, part), {})

    def chance(self, k: int, want: np.ndarray) -> np.ndarray:
        """The interpolated probability in language k of each gram's last symbol after the three before it."""
        p, weight, open_ = np.zeros(len(want)), np.ones(len(want)), np.zeros(len(want), bool)
        high, low = self.parts[k]
        middle, before = _low(want >> np.uint64(16), 32), _low(want >> np.uint64(16), 16)
        for i in range(high):
            mine = np.flatnonzero(_spot(middle >> np.uint64(16), before) % np.uint64(high) == i)
            t = self.unit(k, True, i)
            at, seen = _find(t.get(4, _NONE)[0], want[mine])
            p[mine[seen]] = t[4][1][at[seen]] if seen.any() else 0
            mine = mine[~seen]
            w, three = _get(t.get(14, _NONE), want[mine] >> np.uint64(16)), _low(want[mine], 48)
            at, seen = _find(t.get(3, _NONE)[0], three)
            p[mine[seen]] = w[seen] * t[3][1][at[seen]] if seen.any() else 0
            w, three, mine = w[~seen], three[~seen], mine[~seen]
            weight[mine], open_[mine] = w * _get(t.get(13, _NONE), three >> np.uint64(16)), True
        rest = np.flatnonzero(open_)
        for i in range(low):
            mine = rest[_spot(np.uint64(0), before[rest]) % np.uint64(low) == i]
            t, two = self.unit(k, False, i), _low(want[mine], 32)
            at, seen = _find(t.get(2, _NONE)[0], two)
            p[mine[seen]] = weight[mine[seen]] * t[2][1][at[seen]] if seen.any() else 0
            two, mine = two[~seen], mine[~seen]
            one = _get(t[1], _low(two, 16), float(t[11][1][0]) / (len(t[1][0]) + 1))
            p[mine] = weight[mine] * (_get(t.get(12, _NONE), two >> np.uint64(16)) * one)
        return p

    def entropy(self, counted: list["Counted"]) -> list[np.ndarray]:
        """Cross-entropy of each text of each chunk in each language."""
        every = [g for c in counted for g, *_ in c.slabs]
        own = every[0] if len(every) == 1 else np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]))
        at = [[slice(None) if g is own else np.searchsorted(own, g) for g, *_ in c.slabs] for c in counted]
        out = [np.zeros((len(c.letters), len(self.names))) for c in counted]
        for k in range(len(self.names)):
            cost = -np.log(self.chance(k, own))
            for c, places, total in zip(counted, at, out):
                for (_, back, ptr), place in zip(c.slabs, places):
                    run = np.concatenate([[0.0], np.cumsum(cost[place][back])])
                    total[:, k] += run[ptr[1:]] - run[ptr[:-1]]
        return [total / np.maximum(c.n, 1)[:, None] for c, total in zip(counted, out)]


def _spot(first, second):
    return first * np.uint64(40503) + second * np.uint64(9973)


class Counted:
    """The grams of a chunk of texts, a slab at a time: (distinct grams, each place's gram, where each text's places begin)."""

    def __init__(self, texts: list[bytes]):
        s, edge = symbols(texts)
        self.slabs, self.n, self.letters = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for low in range(0, len(s), SLAB):
            want, at = grams(s, low, low + SLAB)
            own, back = np.unique(want, return_inverse=True)
            ptr = np.searchsorted(at, edge)
            letters = np.concatenate([[0], np.cumsum(s[at] != 32)])
            self.slabs.append((own, back.astype(np.int32), ptr))
            self.n += np.diff(ptr)
            self.letters += letters[ptr[1:]] - letters[ptr[:-1]]
        self.size = len(s)


def _counted(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows: dict[str, int] = {}

    def merge(lang):
        g = np.concatenate([x for x, _ in held[lang]])
        own, back = np.unique(g, return_inverse=True)
        held[lang] = [(own, np.bincount(back, np.concatenate([c for _, c in held[lang]])).astype(np.int64))]
        rows[lang] = len(own)

    def out(lang):
        merge(lang)
        (g, c), = held.pop(lang)
        for low in range(0, len(g), 100_000):
            part = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part])), pa.array(g[part].view(np.int64)), pa.array(c[part])], names=["lang", "gram", "n"])

    for (langs,), texts in chunks(batches):
        by: dict[str, list[bytes]] = {}
        for lang, t in zip(langs.to_pylist(), texts):
            by.setdefault(lang, []).append(t)
        for lang, some in by.items():
            s, _ = symbols(some)
            for low in range(0, len(s), SLAB):
                got = np.unique(grams(s, low, low + SLAB)[0], return_counts=True)
                held.setdefault(lang, []).append(got)
                rows[lang] = rows.get(lang, 0) + len(got[0])
                if rows[lang] > 1_000_000:
                    merge(lang)
            if sum(rows.values()) > 1_000_000:
                for x in held:
                    merge(x)
                if sum(rows.values()) > 500_000:  # memory stays bounded; the counts are summed after the shuffle
                    for x in list(held):
                        yield from out(x)
                    rows.clear()
    for lang in list(held):
        yield from out(lang)


def tables(counted: DataFrame) -> DataFrame:
    """The models of all languages, (lang, higher, spot, kind, key, value), from counts (lang, gram, n).

    spot deals the rows of a language into parts; it is null where every part needs the row, which are those of the lowest order.
    """
    levels = [counted]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer grams with this end
        end = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        levels.insert(0, save(levels[0].groupBy("lang", end.alias("gram")).agg(F.count("*").alias("n")), "levels"))
    out, below = [], None
    for k, level in enumerate(levels, 1):
        one, two = (F.sum((F.col("n") == c).cast("double")) for c in (1, 2))
        discount = F.when(one + two > 0, F.least(F.lit(0.9), F.greatest(F.lit(0.1), one / (one + 2 * two)))).otherwise(0.5)
        discounts = level.groupBy("lang").agg(discount.alias("discount"))
        same = Window.partitionBy("lang", "context")
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16)).join(F.broadcast(discounts), "lang")  # a row for each language
        rows = rows.withColumn("total", F.sum("n").over(same)).withColumn("kinds", F.count("*").over(same))
        rows = rows.select("lang", "gram", "context", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("weight"), "kinds")
        if below is None:
            rows = rows.withColumn("p", F.col("share") + F.col("weight") / (F.col("kinds") + 1))
        else:
            rows = rows.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
            rows = rows.join(below.select("lang", F.col("gram").alias("end"), F.col("p").alias("q")), ["lang", "end"]).withColumn("p", F.col("share") + F.col("weight") * F.col("q"))
        below = save(rows.select("lang", "gram", "context", "weight", "p"), "order")
        weights = below.groupBy("lang", "context").agg(F.max("weight").alias("value"))
        letter = lambda c, i: F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF))
        for kind, frame, key, value, shift in ((_CHANCE[k], below, "gram", "p", 1), (_WEIGHT[k], weights, "context", "value", 0)):
            spot = F.lit(None).cast("long") if k == 1 else letter(key, shift) * 9973 + (letter(key, shift + 1) * 40503 if k > 2 else F.lit(0))
            out.append(frame.select("lang", F.lit(k > 2).alias("higher"), spot.alias("spot"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value")))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return save(union, "models")


def _blocks(table: DataFrame, block: int) -> Languages:
    """The models in broadcasts of about `block` rows, each fetched by itself."""
    rows = table.groupBy("lang", "higher").agg(F.count("*").alias("n")).orderBy("lang", F.desc("higher")).collect()  # two for each language
    names = sorted({r.lang for r in rows})
    size = {(r.lang, r.higher): r.n for r in rows}
    m = Languages(names, [tuple(max(1, -(-size.get((name, h), 0) // block)) for h in (True, False)) for name in names])
    units = [(k, h, i, -(-size.get((name, h), 0) // m.parts[k][not h])) for k, name in enumerate(names) for h in (True, False) for i in range(m.parts[k][not h])]
    batches, total = [], 0
    for u in units:
        if not batches or total + u[3] > block:
            batches.append([])
            total = 0
        batches[-1].append(u)
        total += u[3]
    for some in batches:
        wanted = F.lit(False)
        for k, h, i, _ in some:
            mine = F.col("spot").isNull() | (F.pmod("spot", F.lit(m.parts[k][not h])) == i)
            wanted = wanted | ((F.col("lang") == names[k]) & (F.col("higher") == h) & mine)
        got = table.where(wanted).select("lang", "higher", "spot", "kind", "key", "value").toArrow()  # about `block` rows
        lang, higher, kind = np.array(got["lang"].to_pylist()), got["higher"].to_numpy(), got["kind"].to_numpy()
        spot = got["spot"].fill_null(-1).to_numpy()
        key, value = got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()
        held = {}
        for k, h, i, _ in some:
            mine = (lang == names[k]) & (higher == h) & ((spot < 0) | (spot % m.parts[k][not h] == i)) if len(lang) else np.zeros(0, bool)
            unit = {}
            for c in np.unique(kind[mine]).tolist():
                these = np.flatnonzero(mine & (kind == c))
                these = these[np.argsort(key[these])]
                unit[c] = key[these], value[these]
            held[k, h, i] = unit
            m.where[k, h, i] = len(m.blocks)
            m.size += sum(x.nbytes + y.nbytes for x, y in unit.values())
        m.blocks.append(table.sparkSession.sparkContext.broadcast(held))
    return m


def train(docs: DataFrame, usable: Column | None = None, lang: str = "lang", block: int = BLOCK) -> Languages:
    """Models of every language named in usable rows, from the counts of all their texts."""
    rows = docs.where(usable) if usable is not None else docs
    rows = rows.select(F.col(lang).cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    counted = as_bytes(rows, "lang").mapInArrow(_counted, "lang string, gram long, n long")
    out = _blocks(tables(save(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")), block)
    if out.names:
        # every distinct training text counts; of each only a hash and its cross-entropy, rounded up to 1/STEPS, are shuffled and kept
        each = rows.select(F.lit(None).cast("long").alias("doc_id"), "lang", F.xxhash64("text").cast("string").alias("hash"), "text")
        own = predict(each, out, "lang", "hash").where("lang_pred = lang").select("lang", "hash", (F.ceil(F.col("entropy") * STEPS) / STEPS).alias("entropy"))
        got = own.distinct().groupBy("lang").agg(F.percentile("entropy", 0.995).alias("limit")).collect()  # a row for each language
        limit = {r.lang: r.limit for r in got}
        out.limit = np.array([1.1 * limit[n] if n in limit else np.inf for n in out.names])
    return out


def predict(docs: DataFrame, languages: Languages, *keep: str) -> DataFrame:
    """(doc_id, kept columns, lang_pred, score, entropy, rejected), a row for each row.

    A null text, and one without a letter, is `und` with score 0.  Ties go to the first name.  Repeated
    rows and rows with a null id stay as they are.  The score is the chosen language's share when each
    language's likelihood over up to 50 characters at the text's mean cross-entropy is compared.
    """
    kinds = "".join(f"{c} string, " for c in keep)

    def rows(columns, h, letters):
        known = (letters > 0) & (h.shape[1] > 0)
        if not h.shape[1]:
            h = np.zeros((len(letters), 1))
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp(-np.minimum(letters, 50)[:, None] * (h - least[:, None])).sum(axis=1)
        name = [languages.names[b] if k else "und" for b, k in zip(best, known)]
        beyond = (least > languages.limit[best]) & known if languages.limit is not None else np.zeros(len(h), bool)
        cols = [*columns, pa.array(name, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(beyond | ~known)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", *keep, "lang_pred", "score", "entropy", "rejected"])

    def run(batches):
        most, waiting = 1 if languages.size <= HELD else GROUP, []
        for columns, texts in chunks(batches):
            waiting.append((columns, Counted(texts)))
            if sum(c.size for _, c in waiting) >= most:
                for (old, c), h in zip(waiting, languages.entropy([c for _, c in waiting])):
                    yield rows(old, h, c.letters)
                waiting = []
        for (old, c), h in zip(waiting, languages.entropy([c for _, c in waiting])):
            yield rows(old, h, c.letters)

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", *keep).mapInArrow(run, f"doc_id long, {kinds}lang_pred string, score double, entropy double, rejected boolean")
