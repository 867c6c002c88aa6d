"""Token ids in a canonical, length-limited Huffman code, in blocks that decode alone.

The file format (Parquet rows, so that Spark's committer makes the write safe against
lost executors and any store that Spark reaches can hold it):

  blocks/   part int, block int    place of the block; documents ascend with (part, block)
            first long             ids in this part before the block
            docs array<long>, sizes array<int>   ids of the documents and how many token ids each has
            payload binary         the codes, most significant bit first; a document starts at a whole byte
            lanes binary           little-endian unsigned 16-bit numbers: the bits of each run of LANE
                                   ids of a document.  Their sums are the bit-offset checkpoints.
  code/     id int, bits int       the canonical code: ascending (bits, id) numbers the codes

A decoder starts at every checkpoint of a block at once and looks LIMIT bits up in one
table for each id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, chunks, forget, place, table

#: Bits of the longest code, ids between checkpoints, and ids of a block (a longer document has its own).
LIMIT, LANE, BLOCK = 16, 64, 1 << 17
#: Bits that a decoder can look up at once; a vocabulary in use of more than 1 << LIMIT ids has longer codes, up to this.
MOST_BITS = 17
#: Ids that are packed at once.
_SLAB = 1 << 20
#: Word pieces that a worker remembers before it starts anew.
REMEMBERED = 1_500_000
_SPACES = [(bytes([c]), bytes([c, 32]), bytes([32, c])) for c in b"\n\t\r\v\f\x1c\x1d\x1e\x1f"]
#: White space beyond ASCII that may end before a space.
_WIDE_ENDS = tuple(c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace())
#: Starts of white space beyond ASCII in UTF-8 (and of other characters; such texts go whole).
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_PIECES = table(separators=b" ", lower=False)
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_CHUNK = 3 << 20
_odd: dict[str, np.ndarray] = {}
_tokenizers: dict[int, "ByteTokens"] = {}


class ByteTokens:
    """Ids of whole texts by the tokenizers library, with a memory for pieces between spaces.

    The pre-tokenizer lets a space stand only at the start of a token that goes on with
    other characters, so a piece that neither begins nor ends with white space is tokenized
    the same wherever it stands.  Pieces of a chunk are hashed in numpy (64 and 32 bits, two
    polynomials), the distinct ones looked up in sorted arrays, and the library
    tokenizes those that a worker hasn't met.  Texts with other pieces, or with the
    special token, and very long pieces go through the library whole.
    """

    def __init__(self, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        said = json.loads(model)
        split = said.get("pre_tokenizer") or {}
        # letters between spaces are one token for the merges, which then needn't be cut out of a text
        self.plain = said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.again = np.zeros(0, bool)  # pieces that were met after their first chunk

    def trim(self) -> None:
        """Forget the pieces that didn't come back."""
        keep = np.flatnonzero(self.again)
        if 4 * len(keep) > 3 * REMEMBERED:
            self.clear()
            return
        size = self.size[keep]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(self.place[keep] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        self.hash, self.check, self.size, self.place, self.again = self.hash[keep], self.check[keep], size, end - size, np.zeros(len(keep), bool)
        self.flat, self.used = flat, len(flat)

    @staticmethod
    def regular(t: bytes) -> bool:
        """Whether every piece between spaces can be tokenized apart."""
        if b"  " in t or b"<|" in t or b"\0" in t or t[:1].isspace() or t[-1:].isspace():
            return False
        for w, before, after in _SPACES:
            if w in t and (before in t or after in t):
                return False
        return t.isascii() or not any(w in t for w in _WIDE)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, without special tokens, and each text's first place (and the end)."""
        if len(self.hash) > REMEMBERED:
            self.trim()
        plain = [self.regular(t) for t in texts]
        w = Words([t if ok else b"" for t, ok in zip(texts, plain)], _PIECES, glue=b" ")
        if len(w.start) and int((w.stop - w.start).max()) > 256:
            long = np.unique(w.text_of()[w.stop - w.start > 256])
            for d in long.tolist():
                plain[d] = False
            w = Words([t if ok else b"" for t, ok in zip(texts, plain)], _PIECES, glue=b" ")
        full = w.counts > 0
        rest = np.ones(len(w.hash), bool)
        rest[w.ptr[:-1][full]] = False  # first pieces have no space before them
        alone = [t if not ok else t.partition(b" ")[0] for t, ok in zip(texts, plain)]
        got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in alone], add_special_tokens=False)]
        order = np.argsort(w.hash[rest])
        own = w.hash[rest][order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        own, first, back = own[new], order[new], np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        check = _second(w, rest)
        if (check[first][back] != check).any():  # two pieces with one hash: the library takes the chunk whole
            got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.concatenate(got), np.cumsum([0, *map(len, got)])
        at = self.find(own, check[first], w, np.flatnonzero(rest)[first])
        # a table for this chunk: the distinct pieces, then each text's own start
        heads = np.array([len(g) for g in got], np.int64)
        size = np.concatenate([self.size[at], heads])
        place = np.concatenate([self.place[at], self.used + np.cumsum(heads) - heads])
        self.put(np.concatenate(got))  # behind what is remembered, and overwritten by the next chunk
        flat = self.flat
        order = np.empty(len(w.hash), np.int64)
        order[rest] = back
        order[~rest] = len(own) + np.flatnonzero(full)
        order = np.insert(order, w.ptr[:-1][~full], len(own) + np.flatnonzero(~full))
        sizes = size[order]
        end = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(place[order] - end[:-1], sizes) + np.arange(end[-1])]
        return ids, end[np.concatenate([[0], np.cumsum(np.maximum(w.counts, 1))])]

    def find(self, own: np.ndarray, check: np.ndarray, w: Words, words: np.ndarray) -> np.ndarray:
        """Rows of the memory for distinct pieces; new ones are tokenized."""
        at, seen = self._look(own, check)
        self.again[at[seen]] = True
        if not seen.all():
            new = np.flatnonzero(~seen)
            begin = w.start[words[new]] - 1  # with the blank before it
            size = w.stop[words[new]] - begin
            edge = np.concatenate([[0], np.cumsum(size)])
            joined = w.raw[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
            joined[edge[:-1]] = 32
            ids, cut = self.tokenized(joined, edge)
            self.put(ids)
            value = {"hash": own[new], "check": check[new], "place": self.used + cut[:-1], "size": np.diff(cut), "again": np.zeros(len(new), bool)}
            self.used += len(ids)
            there = np.searchsorted(self.hash, own[new])
            clash = np.append(self.hash, 0)[there] == own[new] if len(self.hash) else np.zeros(len(new), bool)
            for name, v in value.items():
                old = getattr(self, name)
                old[there[clash]] = v[clash]  # one hash, two checks: the later piece is remembered
                setattr(self, name, np.insert(old, there[~clash], v[~clash]))
            at, _ = self._look(own, check)
        return at

    def tokenized(self, joined: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces with a blank before each, which begin at edge, and where each piece's begin."""
        size = np.diff(edge)
        letters = np.add.reduceat(_LETTER[joined], edge[:-1], dtype=np.int64) == size - 1
        letters &= self.plain
        raw = joined.tobytes()
        text = raw.decode("latin-1")
        merges = self.library.model.tokenize
        words = np.flatnonzero(letters)
        ids = [[t.id for t in merges("Ġ" + text[a + 1 : b])] for a, b in zip(edge[words].tolist(), edge[words + 1].tolist())]
        n = np.zeros(len(size), np.int64)
        n[words] = np.fromiter(map(len, ids), np.int64, len(ids))
        others = np.flatnonzero(~letters)
        some = [raw[a:b] for a, b in zip(edge[others].tolist(), edge[others + 1].tolist())]
        together = [b"".join(some[k : k + 100]).decode("utf-8", "replace") for k in range(0, len(some), 100)]
        rest = np.array([i for e in self.library.encode_batch_fast(together, add_special_tokens=False) for i in e.ids], np.uint32)
        n[others] = np.diff(np.searchsorted(np.cumsum(self.bytes[rest]) - self.bytes[rest], np.concatenate([[0], np.cumsum(size[others])])))
        out = np.empty(int(n.sum()), np.uint32)
        mine = np.repeat(letters, n)
        out[mine], out[~mine] = [i for x in ids for i in x], rest
        return out, np.concatenate([[0], np.cumsum(n)])

    def put(self, ids: np.ndarray) -> None:
        """Write ids behind the remembered ones."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(ids) + self.used // 2, np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids

    def _look(self, own: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hash):
            return np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        return at, (self.hash[at] == own) & (self.check[at] == check)


def _second(w: Words, some: np.ndarray) -> np.ndarray:
    """Another hash of the pieces, of 32 bits."""
    n = len(w.norm)
    if len(_odd.get("up", ())) < n:
        for name, base in (("up", 0x01000193), ("down", pow(0x01000193, -1, 1 << 32))):
            one = np.full(max(n, 3 << 20), base, np.uint32)
            one[0] = 1
            _odd[name] = np.multiply.accumulate(one, dtype=np.uint32)
    total = np.zeros(n + 1, np.uint32)
    np.cumsum((w.norm.astype(np.uint32) + np.uint32(77)) * _odd["up"][:n], out=total[1:])
    return (total[w.stop[some]] - total[w.start[some]]) * _odd["down"][w.start[some]]


#: A space between other characters than white space: a token begins there, whatever stands before.
_CUT = re.compile(rb"(?<=[!-~\x80-\xbf])(?= [!-;=-~])")


def parts_of(text: bytes, most: int = 1 << 20) -> list[bytes]:
    """A text in parts of `most` bytes or more whose ids, one part's behind another's, are the text's."""
    out, low, at = [], 0, most
    while at < len(text) and (cut := _CUT.search(text, at)):
        if text.endswith(_WIDE_ENDS, low, cut.start()):
            at = cut.start() + 1
            continue
        out.append(text[low : cut.start()])
        low, at = cut.start(), cut.start() + most
    return [*out, text[low:]]


def tokens(model: bytes) -> ByteTokens:
    key = hash(model)
    if key not in _tokenizers:
        _tokenizers[key] = ByteTokens(model)
    return _tokenizers[key]


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Bits of each id with a count, the least in total of codes of at most `limit` bits, by package-merge.

    From the longest codes up, pairs of the cheapest items of a level are packages of the next, beside
    the ids themselves.  The first 2n - 2 items of the last level are the code: an id gets a bit for each level at which it is taken.
    """
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    if len(counts) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    weight = np.array([counts[i] for i in ids], float)
    level, taken = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weight, level])
        order = np.argsort(both, kind="stable")
        taken.append(np.cumsum(order < len(ids)))  # ids among the first items
        both = both[order]
        level = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    bits, first = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for got in reversed(taken):
        alone = int(got[first - 1]) if first else 0
        bits[:alone] += 1
        first = 2 * (first - alone)
    return dict(zip(ids, bits.tolist()))


class Code:
    def __init__(self, lengths: dict[int, int], limit: int = LIMIT):
        self.limit = limit = max(limit, max(lengths.values(), default=1))
        if limit > MOST_BITS:
            raise ValueError(f"codes of more than {MOST_BITS} bits")
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        size = max(lengths, default=0) + 1
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.symbol, self.step = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
        at = 0
        for i in order:
            width = 1 << (limit - lengths[i])
            self.bits[i], self.codes[i] = lengths[i], at >> (limit - lengths[i])
            self.symbol[at : at + width], self.step[at : at + width] = i, lengths[i]
            at += width

    def pack(self, ids: np.ndarray, ptr: np.ndarray | None = None) -> tuple[list[int], list[bytes], list[bytes]]:
        """(sizes, payloads, lanes) of the texts ids[ptr[i]:ptr[i + 1]]; each starts at a whole byte."""
        ptr = np.array([0, len(ids)]) if ptr is None else ptr
        n = np.diff(ptr)
        end = np.concatenate([[0], np.cumsum(self.bits[ids])])
        own = end[ptr[1:]] - end[ptr[:-1]]
        byte = np.concatenate([[0], np.cumsum((own + 7) // 8)])
        shift = 8 * byte[:-1] - end[ptr[:-1]]
        out = np.zeros((int(byte[-1]) >> 2) + 2, np.uint64)
        for low in range(0, len(ids), _SLAB):
            some = slice(low, low + _SLAB)
            at = np.clip(ptr, low, min(low + _SLAB, len(ids)))
            off = end[:-1][some] + np.repeat(shift, np.diff(at))
            word = off >> 5
            wide = self.codes[ids[some]] << (64 - (off & 31) - self.bits[ids[some]]).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both = np.bitwise_or.reduceat(wide, first)
            out[word[first]] |= both >> np.uint64(32)
            out[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
        raw = out.astype(">u4").tobytes()
        per = -(-n // LANE)
        lane = np.concatenate([[0], np.cumsum(per)])
        mark = np.repeat(ptr[:-1] - LANE * lane[:-1], per) + LANE * np.arange(lane[-1])
        stop = np.minimum(mark + LANE, np.repeat(ptr[1:], per))
        steps = (end[stop] - end[mark]).astype("<u2").tobytes()
        return n.tolist(), [raw[a:b] for a, b in zip(byte[:-1], byte[1:])], [steps[2 * a : 2 * b] for a, b in zip(lane[:-1], lane[1:])]

    def unpack(self, payload: bytes, lanes: bytes, sizes: list[int]) -> np.ndarray:
        """The ids of a block of texts of these sizes: all lanes step together, one table look-up each."""
        raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
        three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        n = np.array(sizes, np.int64)
        per = -(-n // LANE)
        size = np.frombuffer(lanes, "<u2").astype(np.int64)
        if not len(size):
            return np.zeros(0, np.uint32)
        end = np.concatenate([[0], np.cumsum(size)])
        head = np.cumsum(per) - per  # the first lane of each text
        bits = end[head + per] - end[head]
        byte = np.cumsum((bits + 7) // 8) - (bits + 7) // 8
        at = end[:-1] + np.repeat(8 * byte - end[head], per)
        fill = np.full(len(at), LANE, np.int64)
        fill[(head + per - 1)[per > 0]] = (n - (per - 1) * LANE)[per > 0]
        out = np.zeros((LANE, len(at)), np.uint32)
        down, mask = 24 - self.limit, np.uint32((1 << self.limit) - 1)
        last = len(three) - 1
        for k in range(int(fill.max())):
            peek = (three[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[peek]
            at += self.step[peek]
        return out.T[np.arange(LANE) < fill[:, None]]


def _tokenized(model, end: int):
    """Ids of each text and the end id, a byte plane a column: planes press better than whole numbers.  A task's last row holds its counts."""

    def run(batches):
        t, total = tokens(model.value), np.zeros(1 << 16, np.int64)
        for columns, texts in chunks(batches, _CHUNK):
            if len(texts) == 1 and len(texts[0]) > _CHUNK:
                ids = np.concatenate([t.encode([x])[0] for x in parts_of(texts[0])])
                ptr = np.array([0, len(ids)])
            else:
                ids, ptr = t.encode(texts)
            ids = np.insert(ids, ptr[1:], np.uint32(end))
            cut = ptr + np.arange(len(ptr))
            count = np.bincount(ids, minlength=len(total))
            total = np.pad(total, (0, len(count) - len(total))) + count
            planes = []
            for shift in (0, 8, 16):
                raw = (ids >> np.uint32(shift)).astype(np.uint8).tobytes()
                some = shift < 16 or any(raw)
                planes.append(pa.array([raw[a:b] if some else b"" for a, b in zip(cut[:-1], cut[1:])], pa.binary()))
            tie = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tie, pa.int64()), *planes, pa.nulls(len(tie), pa.binary())], names=names)
        if total.any():
            none = [pa.nulls(1, pa.int64())] * 2 + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    names = ["doc_id", "tie", "low", "high", "top", "counts"]
    return run


_TOKENS = "doc_id long, tie long, low binary, high binary, top binary, counts binary"


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's texts behind one another, and each text's first place (and the end)."""
    low, high, top = (batch.column(c).to_pylist() for c in ("low", "high", "top"))
    ids = np.frombuffer(b"".join(low), np.uint8).astype(np.uint32) | np.frombuffer(b"".join(high), np.uint8).astype(np.uint32) << np.uint32(8)
    if any(top):
        ids |= np.frombuffer(b"".join([x or bytes(len(y)) for x, y in zip(top, low)]), np.uint8).astype(np.uint32) << np.uint32(16)
    return ids, np.cumsum([0, *map(len, low)])


def _counted(batches):
    for batch in batches:
        for held in batch.column(0).to_pylist():
            count = np.frombuffer(held, "<i8")
            ids = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(count[ids])], names=["id", "n"])


def _blocks(code):
    """Sorted documents to blocks: their codes behind one another, each from a whole byte.  A task's documents are a part."""

    def run(batches):
        from pyspark import TaskContext

        part, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block():
            nonlocal number, before, held, size
            row = (part, number, before, [x[0] for x in held], [x[1] for x in held], b"".join([x[2] for x in held]), b"".join([x[3] for x in held]))
            number, before, held, size = number + 1, before + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for doc, n, payload, lanes in zip(batch.column("doc_id").to_pylist(), *code.value.pack(*_ids(batch))):
                if held and size + n > BLOCK:
                    yield block()
                held.append((doc, n, payload, lanes))
                size += n
        if held:
            yield block()

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("lanes", pa.binary())])
_BLOCK_DDL = "part int, block int, first long, docs array<long>, sizes array<int>, payload binary, lanes binary"


def decode_blocks(code: Code, batch: pa.RecordBatch) -> Iterator[tuple]:
    """(part, ids in the part before the document, doc_id, its ids) of each document in the blocks."""
    for part, _, first, docs, sizes, payload, lanes in zip(*(x.to_pylist() for x in batch.columns)):
        ids = code.unpack(payload, lanes, sizes)
        low = 0
        for doc, n in zip(docs, sizes):
            yield part, first + low, doc, ids[low : low + n]
            low += n


def _read(code):
    def run(batches):
        c = code.value
        for batch in batches:
            rows = [(part, at, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for part, at, doc, ids in decode_blocks(c, batch)]
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, path: str, model_path: str, end: int = 0) -> None:
    """Write the ids of every whole text, each document's followed by `end`, in ascending doc_id order.

    The ids wait in a table in the shared folder for the counts, the ranges and the codes; it is
    deleted at the end.  Documents are dealt to parts by ranges of doc_id and, where one id (or none) has many rows, of
    a checksum and a row number; null ids come first.  A null text is empty.  Repeated rows are written
    as often as they stand there.  An empty table gives no block.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    held = f"{path}/ids"
    as_bytes(docs, "doc_id").mapInArrow(_tokenized(model, end), _TOKENS).write.option("compression", "zstd").parquet(held)
    stored = spark.read.schema(_TOKENS).parquet(held)
    ids = stored.where("counts is null").drop("counts")
    counts = stored.select("counts").where("counts is not null").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    lengths = code_lengths({r.id: r.n for r in counts}, max(LIMIT, (len(counts) - 1).bit_length()))
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(Code(lengths))
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    numbered = ids.withColumn("row", F.monotonically_increasing_id())  # of a stored table's rows
    dealt = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    dealt.select("doc_id", "low", "high", "top").mapInArrow(_blocks(code), _BLOCK_DDL).write.parquet(f"{path}/blocks")
    forget(spark, held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    lengths = {r.id: r.bits for r in spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()}
    code = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.max(F.col("first") + F.aggregate("sizes", F.lit(0), lambda a, x: a + x)).alias("n")).orderBy("part").collect()  # a row for each part
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r.n
    base = spark.createDataFrame(before, "part int, base long")
    found = blocks.mapInArrow(_read(code), "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Write below the shared folder, then read back."""
    path = place(docs.sparkSession, "ids")
    write(docs, path, model_path)
    return read(docs.sparkSession, path)
