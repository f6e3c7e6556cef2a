"""Shared pieces: durable intermediate tables and vectorised word hashing.

Words everywhere are the maximal byte runs outside ``[\\x20\\x09-\\x0D]`` of the
UTF-8 text; a null text counts as empty.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.session import remember

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ------------------------------------------------------------ durable tables

def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A purely local session (tests) that names none gets a scratch folder; a
    cluster session must name one, as a machine-local folder would lose data.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    a lost executor costs only the tasks that were running on it. ``session.drop_kept``
    removes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> F.Column:
    """64-bit key of a row of ``documents``; equal only for equal rows."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


# ------------------------------------------------------------ Arrow access

def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0, null is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def doc_groups(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer text stands alone)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b


# ------------------------------------------------------------ word hashing

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    global _powers
    if base != _BASE:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))[:n]
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, base, np.uint64)]))
    return _powers[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word
    (one more entry at the end). Words never cross texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash per word (bounded scratch memory: done in blocks)."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        s, e = starts[a:b], ends[a:b]
        lens = e - s
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        rel = np.arange(total) - np.repeat(first, lens)
        vals = (data[rel + np.repeat(s, lens)].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[rel]
        out[a:b] = mix(np.add.reduceat(vals, first) * _MUL + lens.astype(np.uint64))
        a = b
    return out


class Rolling:
    """Hashes of runs of consecutive words, from prefix sums (mod 2^64)."""

    def __init__(self, words: np.ndarray, base: int = 0x5851F42D4C957F2D):
        n = len(words)
        self.pow = powers(n + 1, np.uint64(base))
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        self.inv = powers(n + 1, inv)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.pow[:n], out=self.sum[1:])

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words[a:b] for arrays of bounds."""
        return mix((self.sum[b] - self.sum[a]) * self.inv[a] + (b - a).astype(np.uint64) * _MUL)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.arange(total) - np.repeat(first - starts, lens)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class SliceTable:
    """Finds which slices of many equally long sequences are keys of a fixed vocabulary.

    Keys are sequences of small integers; a slice is told by its 64-bit hash."""

    def __init__(self, keys: list[np.ndarray], values: np.ndarray):
        self.longest = max((len(k) for k in keys), default=1)
        self.pow = powers(4096)
        self.inv = powers(4096, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        hashes = np.zeros(len(keys), np.uint64)
        for size, own in by_length(np.array([len(k) for k in keys], np.int64)):
            hashes[own] = self.slices(self.sums(np.array([keys[k] for k in own]).reshape(len(own), size)), 0, size)
        size = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(keys))))))
        self.mask = np.uint64(size - 1)
        self.hash = np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int64)
        for h, v in zip(hashes.tolist(), values.tolist()):
            at = h & (size - 1)
            while self.value[at] >= 0:
                at = (at + 1) & (size - 1)
            self.hash[at], self.value[at] = h, v

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Prefix sums of a (sequences, length) matrix."""
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * self.pow[: rows.shape[1]], axis=1, out=out[:, 1:])
        return out

    def slices(self, sums: np.ndarray, a: int, b: int) -> np.ndarray:
        return mix((sums[:, b] - sums[:, a]) * self.inv[a] + np.uint64((b - a) * 0x9E3779B9))

    def find(self, sums: np.ndarray, a: int, b: int) -> np.ndarray:
        """The value of slice [a, b) of every row, -1 where it is no key."""
        h = self.slices(sums, a, b)
        at = (h & self.mask).astype(np.int64)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & (self.hash[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            out[wrong] = self.value[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hash[at[wrong]] != h[wrong])]
        return out


def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, indices) groups."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(lengths[own[0]]), own
