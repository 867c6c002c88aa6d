"""What the text operators share: the shared folder, text chunks and word kernels.

Text reaches Python as Arrow batches of UTF-8 bytes.  A batch is cut into chunks
of about CHUNK_BYTES, so the arrays below stay small however long the batch is; a
longer single text is one chunk of its own, whose bytes are hashed a slab at a time.

Tables that are stored on the way lie below the shared folder.  They are deleted when the application
ends, or earlier: `forget` takes one, and `scratch` all that were stored inside it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Bytes that are hashed at once.
SLAB = CHUNK_BYTES + 65536
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers = {}
_scopes: list[list[str]] = []
_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veldspar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: a cut of the lineage."""
    return stored(df, name)[0]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, to be deleted with the scope that is open or when the application ends."""
    home = f"{shared_dir(spark)}/veldspar/{spark.sparkContext.applicationId}"
    if home not in _homes:
        target, system = _located(spark, home)
        system.mkdirs(target)
        system.deleteOnExit(target)
        _homes.add(home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target, system = _located(spark, path)
    system.delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; what is to last is written to a place taken outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            forget(spark, path)


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let Arrow batches end at about 4 MB, so that memory doesn't follow the length of texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


def as_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns, then the text as UTF-8 bytes (null stays null)."""
    small_batches(docs.sparkSession)
    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes"))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Chunks of (the kept columns, the texts); the last column holds the texts, null is empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.columns[-1].to_pylist()]
        low, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield [c.slice(low, i - low) for c in batch.columns[:-1]], texts[low:i]
                low, size = i, 0
            size += len(t) + 1
        if low < len(texts):
            yield [c.slice(low) for c in batch.columns[:-1]], texts[low:]


def table(separators: bytes | None = None, letters: bytes | None = None, lower: bool = True) -> np.ndarray:
    """Byte classes: 0 for a separator, else the byte itself, A-Z lower-cased on request."""
    lut = np.arange(256, dtype=np.uint8)
    if lower:
        lut[65:91] += 32
    out = np.ones(256, bool)
    if separators is not None:
        out[list(separators)] = False
    if letters is not None:
        out[:] = False
        out[list(letters)] = True
        if lower:
            out[65:91] = out[97:123]
    lut[~out] = 0
    return lut


#: Words between white space, and words of digits, letters and anything beyond ASCII.
SPACED = table(separators=b" \t\n\v\f\r")
ALNUM = table(letters=bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLAB)
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            one = np.full(size, base, np.uint64)
            one[0] = 1
            _powers[name] = np.multiply.accumulate(one)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a chunk: byte offsets, 64-bit hashes and each text's range of words."""

    def __init__(self, texts: list[bytes], lut: np.ndarray = ALNUM, fold: bool = False, hashes: bool = True, glue: bytes = b"\n"):
        joined = glue.join(texts) + glue  # one byte that separates words
        self.raw = np.frombuffer(joined, np.uint8)
        self.norm = lut[self.raw]
        if fold:  # the capitals of the Latin-1 letters, which UTF-8 writes as C3 80 to C3 9E
            after = np.flatnonzero(self.raw[:-1] == 0xC3) + 1
            low = self.raw[after]
            self.norm[after[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)]] += 32
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        inside = np.zeros(len(joined) + 1, np.int8)
        inside[1:] = self.norm != 0
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.stop = np.flatnonzero(step == -1)
        self.ptr = np.searchsorted(self.start, self.offset)
        self.counts = np.diff(self.ptr)
        self.n = len(texts)
        if hashes:
            self.hash = mix(self._sums())

    def _sums(self) -> np.ndarray:
        """A polynomial of each word's bytes, whatever stands before it."""
        size = len(self.norm)
        up, down = powers(min(size, SLAB))
        out = np.empty(len(self.start), np.uint64)
        carry, lift, drop, open_ = 0, 1, 1, None  # the sum before a slab, the powers of its first byte's place, and a word that goes on
        for low in range(0, size, SLAB):
            high = min(low + SLAB, size)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.norm[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            a, b = np.searchsorted(self.start, [low, high])
            c, d = np.searchsorted(self.stop, [low + 1, high + 1])
            if open_ is not None and d > c:
                out[c] = (open_[0] + int(total[self.stop[c] - low]) * lift + carry) * open_[1] % (1 << 64)
                c, open_ = c + 1, None
            at = self.start[c:d] - low
            out[c:d] = (total[self.stop[c:d] - low] - total[at]) * down[at]  # no word's sum depends on where it stands
            if b > d and open_ is None:
                at = int(self.start[d] - low)
                open_ = -(int(total[at]) * lift + carry), int(down[at]) * drop
            carry = (carry + int(total[-1]) * lift) % (1 << 64)
            lift, drop = lift * pow(_PRIME, SLAB, 1 << 64) % (1 << 64), drop * pow(_INVERSE, SLAB, 1 << 64) % (1 << 64)
        return out

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(self.n), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        left = np.repeat(self.ptr[1:], self.counts)[:n] - np.arange(n)
        first = np.flatnonzero(left >= k)
        return first, mix(h[first])


def segment_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i + 1]]; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def crc_rest(column: str, modulus: int):
    """crc32 of an id written as text, modulo a number (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


#: Rows of one key that a task may hold, about; keys with more are dealt apart.
HOT = 100_000


def hot_bar(counted: DataFrame, hot: int | None = None) -> int | None:
    """The number of rows (column n) from which on keys are hot, or null where none is; at most `hot` keys can have more."""
    hot = HOT if hot is None else hot
    total, most = counted.agg(F.sum("n"), F.max("n")).first()
    bar = max(hot, (total or 0) // hot)
    return bar if (most or 0) > bar else None


def join_counted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left.join(right, key), where n of right is the number of a key's rows in left: hot keys' rows go out to all executors and stay where they are."""
    bar = hot_bar(right)
    if bar is None:
        return left.join(right.drop("n"), key)
    hot = F.broadcast(right.where(F.col("n") > bar).drop("n"))  # HOT rows at most
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") <= bar).drop("n"), key)
    return left.join(hot, key).unionByName(rest)


def adaptive(spark: SparkSession) -> None:
    """Skewed joins are split at run time, which is Spark's default."""
    for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(name).lower() != "true":
            spark.conf.set(name, "true")
