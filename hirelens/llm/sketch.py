"""Document fingerprints by invertible Bloom lookup sketches (operator 11).

A text is a multiset of *paragraph pieces*: its lines, long lines cut further where
the four bytes just read hash to a fixed value (one place in 64 on average), so an
edit changes only the pieces around it. A piece's digest holds a hash of its bytes,
which of the text's equal pieces it is, and its length in bytes.

The sketch has 3 x m cells; a digest is added to one cell of each third: its number,
its digest and a check hash of it, all sums. Sketches of two versions *subtract*, cell
by cell, to the sketch of their difference, whatever the versions' size. *Peeling*
recovers it: a cell whose sums are those of one digest gives that digest and its
version, and taking it from its other cells lays open the next. If cells are left
over, or the lengths do not add up, the sketches are built again, four times larger
and with other places, until peeling ends clean.

The fingerprint of a text is its smallest sketch with the number of its pieces and
bytes. Likeness is 2 x shared bytes / bytes of both versions, shared meaning in pieces
that the difference does not hold; 1 for two empty texts.

``fingerprints`` looks at each row by itself. ``compare_versions``
joins two tables by doc_id on sketches alone; only ids whose peeling failed are
sketched again. ``with_next`` pairs each row with the next one by doc_id: ranges of
doc_id are tasks, and the first row of each range is also sent to the range before it.

Defined results: a null text is empty (no pieces); repeated rows stay in
``fingerprints`` and ``with_next``, where rows of one id are ordered by a hash of their
text and rows without an id come last; in ``compare_versions`` an id has one text (of
several, the one with the least hash), an id missing on one side is empty there
and null ids are left out. Extra columns are ignored. A piece has at most 1,024 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import as_long, doc_groups, hash_words, keep, mix, text_bytes

CELLS = 8                       # cells in each third of a fingerprint's sketch; a power of two
GROWTH = 4
PIECE = 64                      # bytes between cuts inside a line, on average; a power of two
LONGEST = 1024
_LENGTH = np.uint64(2047)       # the low bits of a digest: the piece's length
_CHECK = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------------ pieces

def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text number) of every paragraph piece, by text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = data == 10
    if n >= 4:
        last = data.astype(np.uint32)
        last = last[:-1] | (last[1:] << np.uint32(8))
        last = last[:-2] | (last[2:] << np.uint32(16))
        near = (last * np.uint32(0x9E3779B1)) >> np.uint32(33 - PIECE.bit_length()) == 0
        for k in range(3):                              # the four bytes are of one text
            at = offs[:-1] - 3 + k
            near[at[(at >= 0) & (at < len(near))]] = False
        cut[3:] |= near
    cut[offs[1:][np.diff(offs) > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.append(0, ends[:-1])
    if (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + place * LONGEST
        ends = np.minimum(starts + LONGEST, stop)
    text = np.searchsorted(offs, starts, "right") - 1
    digest = hash_words(data, starts, ends)
    by = np.lexsort((digest, text))                     # equal pieces of a text are numbered
    new = np.concatenate([[True], (digest[by][1:] != digest[by][:-1]) | (text[by][1:] != text[by][:-1])])
    number = np.arange(len(by)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    digest[by] += number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return (mix(digest) & ~_LENGTH) | (ends - starts).astype(np.uint64), text


def _bytes_of(digest: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, (digest & _LENGTH).astype(np.float64), n).astype(np.int64)


# ------------------------------------------------------------ sketches

def _check(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ np.uint64(0x5DEECE66D)) & _CHECK


def _places(digest: np.ndarray, m: int, level: int) -> list[np.ndarray]:
    """The digest's cell in each third."""
    salt = np.uint64((level * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    return [(mix(digest + salt + np.uint64(k + 1)) & np.uint64(m - 1)).astype(np.int64) + k * m for k in range(3)]


def build(digest: np.ndarray, text: np.ndarray, n: int, m: int, level: int) -> np.ndarray:
    """Sketches of n texts: (3, n, 3m) sums of number, digest and check, modulo 2^64."""
    out = np.zeros((3, n * 3 * m), np.uint64)
    values = (np.uint64(1), digest, _check(digest))
    for place in _places(digest, m, level):
        at = text * (3 * m) + place
        for row, value in zip(out, values):
            np.add.at(row, at, value)
    return out.reshape(3, n, 3 * m)


def peel(cells: np.ndarray, level: int):
    """Recover the digests in differences of sketches: (digest, text, +1 or -1, whether clean by text)."""
    _, n, width = cells.shape
    m = width // 3
    number, total, check = (c.reshape(-1).copy() for c in cells)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(number)
    for _ in range(64 + width):                         # a clean sketch peels in far fewer rounds
        one = look[(number[look] == 1) | (number[look] == np.uint64(0xFFFFFFFFFFFFFFFF))]
        sign = np.where(number[one] == 1, 1, -1)
        digest = np.where(sign == 1, total[one], np.uint64(0) - total[one])
        pure = _check(digest) == np.where(sign == 1, check[one], np.uint64(0) - check[one]) & _CHECK
        one, sign, digest = one[pure], sign[pure], digest[pure]
        if not len(one):
            break
        text = one // width
        _, first = np.unique(digest + mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)
        digest, text, sign = digest[first], text[first], sign[first]
        found.append((digest, text, sign))
        away = np.where(sign == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1))     # minus the sign
        sealed = _check(digest) * away
        touched = []
        for place in _places(digest, m, level):
            at = text * width + place
            np.add.at(number, at, away)
            np.add.at(total, at, digest * away)
            np.add.at(check, at, sealed)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
    clean = ~((number != 0) | (total != 0) | (check & _CHECK != 0)).reshape(n, width).any(axis=1)
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, clean
    return *(np.concatenate(x) for x in zip(*found)), clean


def compare(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS):
    """Differences of n pairs of texts given by their pieces: (digest, pair, +1 or -1), likeness, levels tried."""
    size = _bytes_of(*one, n), _bytes_of(*two, n)
    pending, level, m = np.arange(n), 0, cells
    likeness, tried = np.ones(n), np.zeros(n, np.int64)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(pending):
        slot = np.full(n, -1)
        slot[pending] = np.arange(len(pending))
        left = []
        step = max(1, (1 << 17) // m)                   # bounds the memory of a level
        for a in range(0, len(pending), step):
            own = pending[a: a + step]
            sides = []
            for digest, text in (one, two):
                at = slot[text] - a
                here = (slot[text] >= 0) & (at >= 0) & (at < len(own))
                sides.append(build(digest[here], at[here], len(own), m, level))
            digest, text, sign, clean = peel(sides[0] - sides[1], level)
            gone = _bytes_of(digest[sign == 1], text[sign == 1], len(own)), _bytes_of(digest[sign == -1], text[sign == -1], len(own))
            shared = size[0][own] - gone[0]
            clean &= (shared == size[1][own] - gone[1]) & (shared >= 0)
            both = (size[0] + size[1])[own]
            likeness[own] = np.where(both > 0, 2 * shared / np.maximum(both, 1), 1.0)
            tried[own] = level + 1
            ok = clean[text]
            out.append((digest[ok], own[text[ok]], sign[ok]))
            left.append(own[~clean])
        pending, level, m = np.concatenate(left), level + 1, m * GROWTH
    return tuple(np.concatenate(x) for x in zip(*out)), likeness, tried


_CELL = np.dtype([("number", "<u2"), ("digest", "<u8"), ("check", "<u4")])


def encode(sketches: np.ndarray, digest: np.ndarray, text: np.ndarray) -> list[str]:
    """The fingerprint strings: pieces, bytes and the cells."""
    _, n, width = sketches.shape
    packed = np.empty((n, width), _CELL)
    for name, row in zip(_CELL.names, sketches):
        packed[name] = row                              # modulo the field's size
    counts, size = np.bincount(text, minlength=n), _bytes_of(digest, text, n)
    raw = packed.view(np.uint8).reshape(n, -1)
    return [f"{c}.{b}.{base64.b64encode(row).decode()}" for c, b, row in zip(counts.tolist(), size.tolist(), raw)]


def decode(fingerprint: str) -> tuple[int, int, np.ndarray]:
    """(pieces, bytes, cells (3, 3m)) of a fingerprint."""
    count, size, cells = fingerprint.split(".")
    packed = np.frombuffer(base64.b64decode(cells), _CELL)
    return int(count), int(size), np.array([packed[name] for name in _CELL.names], np.uint64)


def _widened(cells: np.ndarray) -> np.ndarray:
    """Differences of decoded cells, with the sign of the number carried to 64 bits."""
    number = cells[0].astype(np.uint16).astype(np.int16).astype(np.int64)
    return np.stack([as_unsigned(number), cells[1], cells[2]])


def as_unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


# ------------------------------------------------------------ single tables

def _hashed_fingerprints(docs: DataFrame, cells: int, level: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            out: list[str] = []
            for a, b in doc_groups(data, offs):
                digest, text = pieces(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                out += encode(build(digest, text, b - a, cells, level), digest, text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                             ["doc_id", "h", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        run, "doc_id long, h long, fingerprint string")


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return _hashed_fingerprints(docs, cells, 0).drop("h")


_DIFF = "doc_id long, only_old array<long>, only_new array<long>, likeness double, level int, clean boolean"


def compare_versions(old: DataFrame, new: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, only_old, only_new, likeness, level): the digests of the pieces that only one version has.

    Texts are never exchanged: each level joins sketches by id; the ids that failed are
    kept as a table and sketched again, larger, with a semi-join."""
    def side(docs: DataFrame, name: str, m: int, level: int) -> DataFrame:
        own = _hashed_fingerprints(docs.where("doc_id IS NOT NULL"), m, level)
        return own.groupBy("doc_id").agg(F.min(F.struct("h", "fingerprint")).getField("fingerprint").alias(name))

    def run(level: int):
        def peel_rows(batches):
            for batch in batches:
                ids, pairs = batch.column(0), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                cells_, sizes = [], []
                for a, b in pairs:
                    x, y = (decode(s) if s else (0, 0, None) for s in (a, b))
                    zero = np.zeros_like((x[2] if x[2] is not None else y[2]))
                    cells_.append(_widened((zero if x[2] is None else x[2]) - (zero if y[2] is None else y[2])))
                    sizes.append((x[1], y[1]))
                if not cells_:
                    continue
                n, size = len(cells_), np.array(sizes, np.int64)
                digest, text, sign, clean = peel(np.stack(cells_, axis=1), level)
                gone = [_bytes_of(digest[sign == s], text[sign == s], n) for s in (1, -1)]
                shared = size[:, 0] - gone[0]
                clean &= (shared == size[:, 1] - gone[1]) & (shared >= 0)
                both = size.sum(axis=1)
                likeness = np.where(both > 0, 2 * shared / np.maximum(both, 1), 1.0)
                lists = []
                for s in (1, -1):
                    by = np.lexsort((digest, text))
                    by = by[sign[by] == s]
                    lists.append(pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(text[by], np.arange(n + 1)), pa.int32()), pa.array(as_long(digest[by]), pa.int64())))
                yield pa.RecordBatch.from_arrays([ids, *lists, pa.array(likeness), pa.array(np.full(n, level, np.int32)), pa.array(clean)],
                                                 ["doc_id", "only_old", "only_new", "likeness", "level", "clean"])
        return peel_rows

    done, level, m = [], 0, cells
    while True:
        pairs = side(old, "a", m, level).join(side(new, "b", m, level), "doc_id", "full_outer").select("doc_id", "a", "b")
        here = keep(pairs.mapInArrow(run(level), _DIFF), f"peeled-{level}")
        done.append(here.where("clean").drop("clean"))
        failed = here.where("NOT clean").select("doc_id")
        if failed.isEmpty():
            break
        old, new = (x.join(failed, "doc_id", "left_semi") for x in (old, new))
        level, m = level + 1, m * GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ------------------------------------------------------------ a row and the next

def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, packed, ahead) in tasks by ranges of doc_id, sorted, and the number of tasks.

    Each task ends with a row marked ``ahead``: the first one of the range after it
    (of the last range: the first of all). The ranges are those that a sort of the bare
    ids gives, their bounds (one a task) go through the driver."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h")]
    bare = own.select("doc_id", "h").repartitionByRange(n, *order)
    first = bare.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("d"), "h")).alias("b"))
    bounds = sorted(tuple(r.b) for r in first.collect())

    def place(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offs = text_bytes(batch.column(1))
            keys = [(i is None, i or 0, h) for i, h in zip(ids, hashes)]
            part = [bisect_right(bounds, k) - 1 for k in keys]
            ahead = [k for k, key in enumerate(keys) if bounds[part[k]] == key]
            packed = pa.array([pack.compress(data[a:b]) for a, b in zip(offs[:-1], offs[1:])], pa.binary())
            row = np.concatenate([np.arange(len(ids)), np.array(ahead, np.int64)])
            flag = np.arange(len(row)) >= len(ids)
            part = np.array(part, np.int32)[row]
            part[flag] = (part[flag] - 1) % len(bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(flag), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), packed.take(pa.array(row))],
                ["part", "ahead", "doc_id", "h", "packed"])

    rows = own.mapInArrow(place, "part int, ahead boolean, doc_id long, h long, packed binary")
    parts = max(1, len(bounds))
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "ahead", F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "packed", "ahead"), parts


def edited_text(text: str, after: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, edited_levels int, next_levels int")


def edited_and_next(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per row its fingerprint, that of its edited text and the likeness to it and to the next row's text."""
    def group(ids: list, texts: list[bytes]):
        n = len(ids)
        plain = [t.decode() for t in texts]
        changed = [edited_text(a, b).encode() for a, b in zip(plain, plain[1:])]
        base, edit = pieces(*_joined(texts)), pieces(*_joined(changed))
        sketch, edited = build(*base, n + 1, cells, 0), build(*edit, n, cells, 0)
        mine = tuple(x[base[1] < n] for x in base)
        after = base[0][base[1] > 0], base[1][base[1] > 0] - 1
        _, near_edited, tried = compare(mine, edit, n, cells)
        _, near_next, more = compare(mine, after, n, cells)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in plain[:n]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            pa.array(encode(sketch, *base)[:n], pa.string()), pa.array(encode(edited, *edit), pa.string()),
            pa.array(near_edited), pa.array(near_next), pa.array(tried.astype(np.int32)), pa.array(more.astype(np.int32))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "edited_levels", "next_levels"])

    def run(batches):
        ids, texts, size = [], [], 0                    # rows in order; the last one waits for its next
        over = False
        for batch in batches:
            open_ = zstandard.ZstdDecompressor().decompress
            for i, raw, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                if over:
                    continue                            # a repeated first row of the next range
                texts.append(open_(raw))
                over = ahead
                if not ahead:
                    ids.append(i)
                size += len(texts[-1])
                if len(ids) > 1 and size > 1 << 20 and not over:
                    yield group(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if ids:
            yield group(ids, texts)

    rows, _ = with_next(docs)
    return rows.mapInArrow(run, _EDITED)
