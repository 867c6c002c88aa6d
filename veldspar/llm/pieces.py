"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that start at a word mark; no piece of the vocabulary holds
the mark after another character (checked at load), so no merge crosses a segment's
start.  Nor does one cross two neighbouring characters that no piece holds side by side, so segments are cut there
(which leaves a few characters together in text without spaces).  The segments that a worker hasn't met are laid end to end
as one flat array of symbols.  Each round takes the least pair rank of every segment, merges its
leftmost occurrence in all segments at once, looks up the two new pairs beside each
merge, drops the merged symbols, and moves finished segments out, until no pair remains.  Where a merge
can't open a pair of lower rank, all its occurrences in a segment merge in one round, which changes nothing but the number of rounds.
Segments of more than LONG characters that are still open after FIRST rounds are finished with a heap, since rounds
could be as many as their symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import as_bytes, chunks

MARK = "▁"
LONG, FIRST = 400, 24
#: Segments that a worker remembers before it starts anew, bytes of them, and characters of a segment that is remembered.
REMEMBERED, HELD, SHORT = 350_000, 96 << 20, 200
#: Characters that are merged at once, and of a text that is encoded at once, about.
_SLAB, _PART = 1 << 20, 4 << 20
_NONE = np.int64(1 << 40)
_coders: dict[int, "PieceCoder"] = {}


class PieceCoder:
    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = sp.get_piece_size()
        self.eos = sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(self.n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.n)]
        bytes_ = [sp.is_byte(i) for i in range(self.n)]
        normal = [i for i in range(self.n) if not special[i] and not bytes_[i]]
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds the word mark after another character")
        if sum(bytes_) != 256:
            raise ValueError("the model has no byte pieces")
        probe = "  ①ﬁ  Ａe\u0301\u200b\n x  "
        if sp.decode(sp.encode(probe)) != probe or not sp.encode_as_pieces("a")[0].startswith(MARK) or sp.encode_as_pieces("  a") != sp.encode_as_pieces(" " + MARK + "a"):
            raise ValueError("the model changes texts or puts no mark before them")
        self.byte_id = np.zeros(256, np.int64)
        self.surface = []
        for i, name in enumerate(names):
            if bytes_[i]:
                self.byte_id[int(name[3:5], 16)] = i
                self.surface.append(bytes([int(name[3:5], 16)]))
            else:
                self.surface.append(" ⁇ ".encode() if sp.is_unknown(i) else b"" if special[i] else name.replace(MARK, " ").encode())
        self.is_byte = bytes_
        self.marked = [not (special[i] or bytes_[i]) and names[i].startswith(MARK) for i in range(self.n)]
        self.silent = [special[i] and not sp.is_unknown(i) for i in range(self.n)]
        self.decimal = [str(i).encode() for i in range(self.n)]
        # every character in a piece is a symbol; those that aren't pieces themselves get ids after the vocabulary
        ids = {names[i]: i for i in normal}
        symbols = dict(ids)
        for ch in sorted({ch for i in normal for ch in names[i]}):
            symbols.setdefault(ch, self.n + len(symbols))
        self.size = max(symbols.values()) + 1
        self.char = np.full(0x110000, -1, np.int64)
        for name, i in symbols.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        scores = np.array([sp.get_score(i) for i in range(self.n)])
        rank = np.zeros(self.n, np.int64)
        rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        pairs = [(symbols[name[:j]] * self.size + symbols[name[j:]], i) for name, i in ids.items() for j in range(1, len(name)) if name[:j] in symbols and name[j:] in symbols]
        key, made = np.array(sorted(pairs), np.int64).T
        self.key, self.value = key, rank[made] * self.size + made  # rank first, and what the pair becomes
        opens = np.zeros(self.size, bool)  # pieces that stand in a pair of lower rank than their own
        for part in (key // self.size, key % self.size):
            lower = (part < self.n) & (rank[made] < rank[np.minimum(part, self.n - 1)])
            opens[part[lower]] = True
        alone = np.bincount(rank[made][np.unique(made, return_index=True)[1]], minlength=self.n) == 1
        self.at_once = ~opens
        self.at_once[: self.n] &= alone[rank]
        self.beside = np.unique([ord(a) << 21 | ord(b) for name in ids for a, b in zip(name, name[1:])])
        self.pairs: dict[int, int] = {}
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)
        self.lengths = np.array([len(x) for x in self.surface])
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.byte_like, self.mute = np.array(bytes_), np.array(self.silent)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []  # little-endian, 32 bits
        self.digits: list[bytes] = []
        self.held = 0

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[at] == want) & (left >= 0) & (right >= 0), self.value[at], _NONE)

    def rounds(self, sym: np.ndarray, at: np.ndarray, seg: np.ndarray, most: int | None = None) -> tuple[tuple, tuple]:
        """Merged (symbols, places, segments) of finished segments and of those still open after `most` rounds."""
        best = np.full(len(sym), _NONE)
        best[:-1] = self.look(sym[:-1], sym[1:])
        best[:-1][seg[1:] != seg[:-1]] = _NONE  # no pair reaches over a segment's end
        done = []
        while len(sym) and most != 0:
            most = most and most - 1
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            size = np.diff(np.concatenate([first, [len(seg)]]))
            least = np.repeat(np.minimum.reduceat(best, first), size)
            over = least == _NONE
            if over.any():
                done.append((sym[over], at[over], seg[over]))
                sym, at, seg, best, least = sym[~over], at[~over], seg[~over], best[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(best == least)
            new = np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])
            # of occurrences that overlap in a row, every other one counts from the left
            run = np.flatnonzero(new | np.concatenate([[True], np.diff(hit) > 1]))
            turn = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate([run, [len(hit)]])))
            hit = hit[new | (self.at_once[best[hit] % self.size] & (turn % 2 == 0))]
            sym[hit] = best[hit] % self.size
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            end = np.ones(len(seg), bool)
            end[:-1] = seg[1:] != seg[:-1]
            tail = end[hit + 1]
            place = np.cumsum(keep) - 1
            hit = place[hit]
            sym, at, seg, best = sym[keep], at[keep], seg[keep], best[keep]
            best[hit] = _NONE
            inner = hit[~tail]
            best[inner] = self.look(sym[inner], sym[inner + 1])
            before = hit[hit > 0]
            before = before[seg[before - 1] == seg[before]]
            best[before - 1] = self.look(sym[before - 1], sym[before])
        none = (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*done, none)), (sym, at, seg)

    def heap(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places) that the same merges leave of one long segment."""
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), self.value.tolist()))
        table = self.pairs
        value = self.look(symbols[:-1], symbols[1:])
        sym = symbols.tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        some = np.flatnonzero(value != _NONE)
        queue = [(v // self.size, i, sym[i], sym[i + 1], v % self.size) for i, v in zip(some.tolist(), value[some].tolist())]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and sym[left] >= 0 and sym[right] >= 0:
                    v = table.get(sym[left] * self.size + sym[right])
                    if v is not None:
                        heapq.heappush(queue, (v // self.size, left, sym[left], sym[right], v % self.size))
        left = np.flatnonzero(alive)
        return np.array(sym, np.int64)[left], left

    def merged(self, points: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places) of code points; a character that is no piece has an id for each of its bytes."""
        sym, at = self.char[points], np.arange(len(points))
        long = np.bincount(seg)[seg] > LONG
        parts = [self.rounds(sym[~long], at[~long], seg[~long])[0]]
        if long.any():
            closed, (sym, at, seg) = self.rounds(sym[long], at[long], seg[long], FIRST)
            parts.append(closed)
            cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]])) if len(seg) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1], cut[1:]):
                some, left = self.heap(sym[a:b])
                parts.append((some, at[a:b][left], seg[a:b][left]))
        sym, at, _ = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        sym, at = sym[order], at[order]
        whole = (sym >= 0) & (sym < self.n)
        if whole.all():
            return sym, at
        code = points[at]
        size = np.where(whole, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        ids = np.repeat(sym, size)
        odd = code[~whole].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[np.repeat(~whole, size)] = self.byte_id[np.frombuffer(odd, np.uint8)]
        return ids, np.repeat(at, size)

    def encode_segments(self, segments: list[str]) -> list[np.ndarray]:
        """The ids of each segment, with its marks."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        end = np.cumsum(lengths)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        apart = np.ones(len(points), bool)
        for low in range(1, len(points), _SLAB):
            some = points[low - 1 : low + _SLAB].astype(np.int64)
            code = some[:-1] << 21 | some[1:]
            apart[low : low + _SLAB] = self.beside[np.minimum(np.searchsorted(self.beside, code), len(self.beside) - 1)] != code
        apart[end[:-1]] = True
        first = np.flatnonzero(apart)
        low, ids, at = 0, [], []
        while low < len(points):  # slabs end where a segment does
            k = np.searchsorted(first, low + _SLAB)
            high = int(first[k]) if k < len(first) else len(points)
            got, where = self.merged(points[low:high], np.cumsum(apart[low:high]) - 1)
            ids.append(got.astype("<i4"))
            at.append((where + low).astype(np.int32))
            low = high
        if not ids:
            return []
        ids, at = np.concatenate(ids), np.concatenate(at)
        return np.split(ids, np.searchsorted(at, end[:-1]))

    def segments(self, text: str) -> list[str]:
        """The text's segments without their first word mark; those with odd marks start with a mark."""
        if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        # one mark is cut off again from the ordinary ones, so that both forms share an entry
        return [s[1:] if s[0] == MARK and s[1:2] not in ("", MARK) else s for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))]

    def places(self, texts: list[str]) -> list[list[int]]:
        """For each text the entries of its segments; new segments are encoded together."""
        if len(self.index) > REMEMBERED or self.held > HELD:
            self.clear()
        index, new, size = self.index, [], len(self.ids)
        out = []
        for t in texts:
            parts = self.segments(t)
            got = list(map(index.get, parts))
            if None in got:
                for i, p in enumerate(got):
                    if p is None:
                        p = index.get(parts[i])
                        if p is None:
                            p = size + len(new)
                            if len(parts[i]) <= SHORT:
                                index[parts[i]] = p
                            new.append(parts[i])
                        got[i] = p
            out.append(got)
        for ids in self.encode_segments([s if s[0] == MARK else MARK + s for s in new]):
            self.ids.append(ids.tobytes())
            self.digits.append(b" ".join([b" ".join(map(self.decimal.__getitem__, ids[k : k + _SLAB].tolist())) for k in range(0, len(ids), _SLAB)]))
            self.held += 12 * len(ids) + 100
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts that are encoded each by itself; the space between two of them opens the later one."""
        low, at = 0, _PART
        while at < len(text):
            at = text.find(" ", at)
            if at < 0:
                break
            if text[at - 1] in (" ", MARK) or text[at + 1 : at + 2] in ("", " ", MARK):
                at += 1
                continue
            yield text[low:at]
            low, at = at + 1, at + 1 + _PART
        yield text[low:]

    def batches(self, texts: list[str]) -> Iterator[list[list[int]]]:
        """The entries of the segments of all texts, then of the parts of a very long one, which comes alone."""
        if len(texts) == 1 and len(texts[0]) > _PART:
            yield from (self.places([p]) for p in self.parts(texts[0]))
        else:
            yield self.places(texts)

    def taken(self, entries: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids.__getitem__, entries)), "<i4")

    def encode(self, text: str) -> list[int]:
        """The ids of a text with the end id."""
        return [*(i for (got,) in self.batches([text]) for i in self.taken(got).tolist()), self.eos]

    def said(self, ids: np.ndarray, begins: bool = True) -> bytes:
        """The text of ids as UTF-8; a byte that is no part of a character becomes U+FFFD."""
        raw = b"".join([self._surface(ids[k : k + _SLAB]) for k in range(0, len(ids), _SLAB)])
        if begins and len(ids):
            heard = np.flatnonzero(~self.mute[ids[:8]])
            first = int(ids[heard[0]]) if len(heard) else next((i for i in ids.tolist() if not self.silent[i]), None)
            if first is not None and self.marked[first]:
                raw = raw[1:]
        if self.byte_like[ids].any():
            try:
                raw.decode("utf-8")
                broken = self.mute[ids[:-1]].any()
            except UnicodeDecodeError:
                broken = True
            if broken:
                raw = self.spelled_out(ids.tolist(), begins).encode()
        return raw

    def _surface(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        end = np.cumsum(size)
        return self.surfaces[np.repeat(self.begin[ids] - (end - size), size) + np.arange(end[-1])].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of any ids."""
        return self.said(np.array(ids, np.int64)).decode("utf-8")

    def spelled_out(self, ids: list[int], begins: bool = True) -> str:
        """The same one id after another, for bytes that are no character."""
        out, run, begun = [], bytearray(), not begins

        def flush():
            low = 0
            while low < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[low : low + size]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                low += size
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
                begun = True
                continue
            flush()
            s = self.surface[i].decode("utf-8")
            if not begun and self.marked[i]:
                s = s[1:]
            begun |= not self.silent[i]
            out.append(s)
        flush()
        return "".join(out)


def coder(model: bytes) -> PieceCoder:
    """The worker's coder of a model, built once."""
    key = hash(model)
    if key not in _coders:
        _coders[key] = PieceCoder(model)
    return _coders[key]


def _whole(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def _digests(model, with_ids: bool):
    def run(batches):
        c = coder(model.value)
        end = b"%d" % c.eos
        for (doc_ids,), texts in chunks(batches, 4 << 20):
            n, a, b, listed = [], [], [], []
            for part, entries in enumerate(c.batches(_whole(texts))):
                for got in entries:
                    ids = c.taken(got)
                    digits = b" ".join(map(c.digits.__getitem__, got))
                    if part == 0:
                        n.append(0)
                        a.append(hashlib.sha256())
                        b.append(hashlib.sha256())
                        listed.append([])
                    n[-1] += len(ids)
                    if digits:
                        a[-1].update(digits + b" ")
                    b[-1].update(c.said(ids, part == 0))
                    if with_ids:
                        listed[-1].append(ids)
            for h in a:
                h.update(end)
            cols = [doc_ids, pa.array([x + 1 for x in n], pa.int64()), pa.array([h.hexdigest() for h in a]), pa.array([h.hexdigest() for h in b])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([np.append(np.concatenate([*x, np.zeros(0, np.int32)]), np.int32(c.eos)).astype(np.int32) for x in listed], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _encoded(model):
    def run(batches):
        c = coder(model.value)
        for columns, texts in chunks(batches, 4 << 20):
            out = [[] for _ in texts]
            for entries in c.batches(_whole(texts)):
                for held, got in zip(out, entries):
                    held.append(c.taken(got))
            ids = [np.append(np.concatenate(x), c.eos).astype(np.int32) for x in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(model):
    def run(batches):
        c = coder(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array([None if i is None else c.decode(i) for i in batch.columns[1].to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _model(df: DataFrame, path: str):
    """The model file, which the driver reads; its size doesn't depend on the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int> with the end id).  Null and empty texts give the end id alone."""
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return as_bytes(docs, "doc_id").mapInArrow(_encoded(_model(docs, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(_model(encoded, path)), "doc_id long, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, one row per row; on request ids array<int> too.

    Ids are those of the encoder above with the end id; the decoded text is what the decoder makes
    of them.  Null and empty texts have one id and decode to an empty text; null ids of
    documents and repeated rows stay; other columns are not read.
    """
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return as_bytes(docs, "doc_id").mapInArrow(_digests(_model(docs, path), with_ids), kinds)
