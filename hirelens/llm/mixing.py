"""Language-model scoring by logistic context mixing (operator 1).

A text is modelled as its lower-cased words, a space between words and a line
feed at the end. Every byte is a path of binary decisions in a Huffman tree of
the training bytes (frequent bytes have few decisions; every byte has a path).
For each decision, several predictors look up a hashed context (the tree node
with the last two, three or four bytes, or the word so far) and give the
log odds of the counts gathered there. A mixer adds them with weights chosen by
a gate (how often the word so far and the last four bytes were seen); an
adaptive probability map refines the sum by node. The score is the sum of the decisions'
log probabilities; over its bytes it gives the bits per byte.

Learning, on the documents outside the held-out fold, in passes over the text:

1. word counts (for the base score) and byte counts;
2. context counts of folds 2-4: each task adds up tables in blocks, blocks are
   summed by key, so what is gathered follows the input;
3. fold 0 is unseen by then: each task trains mixer and map online over its
   documents, batch by batch; the tasks' weights are averaged, the maps' and
   further context counts are added up;
4. all documents are scored with the tables of all training folds. The model is fixed by
   then, so a byte's cost follows from its contexts and is worked out once (``Costs``).

Tables have fixed sizes (``BITS``), so model and broadcast are bounded.
The base score needs the count of every word: up to ``COMMON`` most frequent ones
are broadcast, the others are joined by their 64-bit hash.

Defined results: null or empty text is the end token alone; a null id belongs to
the training folds by the crc32 of an empty string; repeated rows are counted as
often as they stand and scored each; without training text every decision has
probability one half; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import as_long, doc_groups, hash_words, keep, lower_ascii, mix, ragged, text_bytes, word_bounds

CHUNK = 1 << 16                 # bytes per vectorised step: keeps its arrays in cache
MEMO = 20                       # bits of a task's table of byte costs
COMMON = 1 << 18
BLOCK = 1 << 17                 # cells of a table block
TOGETHER = 64                   # tasks whose blocks are added up first
MOST = 1 << 29                  # decisions after which a task gives out its cells
ORDERS = ("o2", "o3", "o4", "word")
BITS = {"o2": 19, "o3": 21, "o4": 22, "word": 22}
SCALE = 14.0                    # steps of a stored log odds per unit
FINE = 256                      # steps of a mixed log odds per unit
TOP = 15 * FINE
BUCKETS = 33
LEVELS = 8                      # of how often a context was seen
GATES = LEVELS * LEVELS
RATE = 0.1
END = np.uint64(0x454E44)       # the end token's hash (mixed below)


# ------------------------------------------------------------ text as bytes and decisions

def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, word hashes, first words): each text as its words, spaces between, line feed last."""
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offs)
    words = hash_words(low, starts, ends)
    n = len(offs) - 1
    blank = np.flatnonzero(np.diff(first) == 0)
    s = np.insert(starts, first[blank], 0)
    size = np.insert(ends - starts, first[blank], 0) + 1
    out = np.append(low, np.uint8(10))[np.minimum(ragged(s, size), len(low))]
    last = np.cumsum(size) - 1
    out[last] = 32
    tokens = np.diff(first)
    tokens[blank] = 1
    final = last[np.cumsum(tokens) - 1] if n else last
    out[final] = 10
    return out, np.concatenate([[0], final + 1]), words, first


@dataclass
class Code:
    """A Huffman tree of byte counts: per byte the nodes on its path and the branches taken."""
    start: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    node_mix: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]       # (weight, order, node); 256 leaves
        heapq.heapify(heap)
        parent, branch, made = {}, {}, 256
        while len(heap) > 1:
            (wa, oa, a), (wb, ob, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], branch[a], parent[b], branch[b] = made, 0, made, 1
            heapq.heappush(heap, (wa + wb, made, made))
            made += 1
        paths = []
        for byte in range(256):
            path, at = [], byte
            while at in parent:
                path.append((parent[at] - 256, branch[at]))
                at = parent[at]
            paths.append(path[::-1])
        size = np.array([len(p) for p in paths])
        flat = [x for p in paths for x in p]
        node = np.array([x[0] for x in flat], np.int32)
        return Code(np.cumsum(size) - size, size, node, np.array([x[1] for x in flat], np.int8),
                    (mix(node.astype(np.uint64) + np.uint64(12345)) >> np.uint64(32)).astype(np.uint32))


def _before(text: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The byte k places back; a line feed before the start of a text."""
    out = np.empty_like(text)
    out[k:] = text[: len(text) - k]
    out[:k] = 10
    for j in range(k):
        at = first + j
        out[at[at < len(text)]] = 10
    return out


def _word_state(text: np.ndarray, carry: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """(sum, length) of the word so far before each byte; ``carry`` is that of the word that goes on at the start."""
    n = len(text)
    at = np.arange(n)
    after = np.flatnonzero((text == 32) | (text == 10)) + 1
    begin = np.concatenate([at[:1], after[after < n]])
    size = np.diff(np.append(begin, n))
    rel = at - np.repeat(begin, size)
    if n:
        rel[: size[0]] += carry[1]
    vals = np.cumsum((text.astype(np.uint32) + np.uint32(1)) * _WORD_POWERS[np.minimum(rel, len(_WORD_POWERS) - 1)], dtype=np.uint32)
    before = np.concatenate([np.zeros(1, np.uint32), vals[:-1]])[:n]
    total = before - np.repeat(before[begin], size)
    if n:
        total[: size[0]] += np.uint32(carry[0])
    return total, rel


def _raw_contexts(text: np.ndarray, offs: np.ndarray, carry: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Per byte the four bytes before it, and the 24-bit context of the word so far."""
    first = offs[:-1]
    b = [_before(text, first, k).astype(np.uint32) for k in (1, 2, 3, 4)]
    total, rel = _word_state(text, carry)
    return (b[0] | b[1] << np.uint32(8) | b[2] << np.uint32(16) | b[3] << np.uint32(24),
            _mix32(total + rel.astype(np.uint32) + np.uint32(3 * 0x51ED270B & 0xFFFFFFFF)) >> np.uint32(8))


def _byte_contexts(last: np.ndarray) -> list[np.ndarray]:
    """The 24-bit contexts of the last two, three and four bytes."""
    return [_mix32((last & np.uint32(m)) + np.uint32(i * 0x51ED270B & 0xFFFFFFFF)) >> np.uint32(8)
            for i, m in enumerate((0xFFFF, 0xFFFFFF, 0xFFFFFFFF))]


def _contexts(text: np.ndarray, offs: np.ndarray, carry: tuple[int, int] = (0, 0)) -> list[np.ndarray]:
    """A 24-bit context per byte and predictor."""
    last, word = _raw_contexts(text, offs, carry)
    return [*_byte_contexts(last), word]


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


_WORD_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint32), np.full(63, 0x01000193, np.uint32)]), dtype=np.uint32)


def _slots(order: str, context: np.ndarray, node_mix: np.ndarray) -> np.ndarray:
    """Table cells of (context, node) pairs."""
    return (((context * np.uint32(0x85EBCA6B) ^ node_mix) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS[order])).astype(np.int64)


class Decisions:
    """The binary decisions of normalised texts; the first ``skip`` bytes only serve as context."""

    def __init__(self, text: np.ndarray, offs: np.ndarray, code: Code, skip: int = 0, carry: tuple[int, int] = (0, 0)):
        contexts = _contexts(text, offs, carry)
        self._take(text[skip:], [c[skip:] for c in contexts], code)
        self.offs = np.concatenate([[0], np.cumsum(code.size.take(text[skip:]))])[np.maximum(offs - skip, 0)]

    def _take(self, text: np.ndarray, contexts: list[np.ndarray], code: Code) -> np.ndarray:
        size = code.size.take(text)
        at = ragged(code.start.take(text), size)
        self.bit, self.node = code.bit.take(at), code.node.take(at)
        nodes = code.node_mix.take(at)
        self.slots = [_slots(o, np.repeat(c, size), nodes) for o, c in zip(ORDERS, contexts)]
        return size

    @classmethod
    def of_bytes(cls, text: np.ndarray, contexts: list[np.ndarray], code: Code) -> tuple[Decisions, np.ndarray]:
        """The decisions of single bytes with their contexts, and the first one of each."""
        own = cls.__new__(cls)
        size = own._take(text, contexts, code)
        return own, np.cumsum(size) - size


class Costs:
    """Log probabilities of bytes under a model that no longer changes.

    A byte's cost follows from the four bytes before it, the context of the word so far and the byte:
    64 bits. Costs once worked out stay in a direct-mapped table, told apart by all 64 bits."""

    def __init__(self, code: Code, tables: list[np.ndarray], mixer: Mixer, fix: np.ndarray):
        self.code, self.tables, self.mixer, self.fix = code, tables, mixer, fix
        self.key = np.full(1 << MEMO, 0xFFFFFFFFFFFFFFFF, np.uint64)      # no text has four bytes 255
        self.cost = np.zeros(1 << MEMO)

    def of(self, text: np.ndarray, offs: np.ndarray, skip: int = 0, carry: tuple[int, int] = (0, 0)) -> np.ndarray:
        last, word = (c[skip:] for c in _raw_contexts(text, offs, carry))
        text = text[skip:]
        key = last.astype(np.uint64) << np.uint64(32) | (word << np.uint32(8) | text).astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO)).astype(np.int64)
        out = self.cost.take(slot)
        new = np.flatnonzero(self.key.take(slot) != key)
        if len(new):
            d, first = Decisions.of_bytes(text[new], [*_byte_contexts(last[new]), word[new]], self.code)
            out[new] = np.add.reduceat(self.mixer.cost(self.tables, self.fix, d), first)
            self.key[slot[new]], self.cost[slot[new]] = key[new], out[new]
        return out


def texts_of(data: np.ndarray, offs: np.ndarray):
    """(first row, bytes, offsets, words, first words) of normalised texts, about CHUNK bytes at a time."""
    for a, b in doc_groups(data, offs, CHUNK):
        yield a, *normalised(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])


def parts_of(text: np.ndarray, offs: np.ndarray):
    """(bytes, offsets, skip, carry): the texts at once, or a long text in parts. A part starts with the
    four bytes before it (``skip``) and carries on the word that it starts in."""
    if len(offs) > 2 or len(text) <= 2 * CHUNK:
        yield text, offs, 0, (0, 0)
        return
    carry, back = (0, 0), 0
    for p in range(0, len(text), CHUNK):
        part = text[back: p + CHUNK]
        yield part, np.array([0, len(part)]), p - back, carry
        total, rel = _word_state(part, carry)
        then = max(0, p + CHUNK - 4)
        if then < len(text):
            carry, back = (int(total[then - back]), int(rel[then - back])), then


# ------------------------------------------------------------ counts

class Counts:
    """Hashed tables of (zeros, ones) per predictor.

    (context, byte) pairs are collected and sorted; each distinct pair then adds its number of
    occurrences along the byte's path. A task's cells have 32 bits: past ``MOST`` decisions it is
    to give out its ``blocks`` (``full``) and goes on with empty cells; sums of blocks have 64."""

    def __init__(self, code: Code):
        self.code = code
        self.cells = [np.zeros(2 << BITS[o], np.int32) for o in ORDERS]
        self.waiting: list[list[np.ndarray]] = [[] for _ in ORDERS]
        self.n = 0
        self.held = 0               # decisions in the cells: none can hold more

    def full(self) -> bool:
        return self.held > MOST

    def add(self, text: np.ndarray, offs: np.ndarray, skip: int = 0, carry: tuple[int, int] = (0, 0)) -> None:
        for w, c in zip(self.waiting, _contexts(text, offs, carry)):
            w.append((c << np.uint32(8) | text)[skip:])
        self.n += len(text) - skip
        if self.n > 1 << 22:
            self.flush()

    def flush(self) -> None:
        code = self.code
        for o, cells, w in zip(ORDERS, self.cells, self.waiting):
            if not w:
                continue
            pair = np.sort(np.concatenate(w))
            w.clear()
            if cells is self.cells[0]:
                self.held += int(np.bincount(pair & np.uint32(255), minlength=256) @ code.size)
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            times = np.diff(np.append(new, len(pair))).astype(np.int32)
            pair = pair[new]
            for k in range(0, len(pair), 1 << 18):
                own = pair[k: k + (1 << 18)]
                byte = own & np.uint32(255)
                size = code.size.take(byte)
                at = ragged(code.start.take(byte), size)
                slot = _slots(o, np.repeat(own >> np.uint32(8), size), code.node_mix.take(at))
                np.add.at(cells, slot * 2 + code.bit.take(at), np.repeat(times[k: k + (1 << 18)], size))
        self.n = 0

    def blocks(self):
        """(predictor, block, packed cells) of the blocks that hold anything; the cells are empty then."""
        self.flush()
        for o, cells in enumerate(self.cells):
            for k, part in enumerate(np.split(cells, range(BLOCK, len(cells), BLOCK))):
                if part.any():
                    yield o, k, _pack(part)
            cells.fill(0)
        self.held = 0


def _pack(cells: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(cells.astype(np.int64).view(np.uint8).reshape(-1, 8).T))


def _unblock(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A cell as stored: its log odds (zero where nothing was seen) times LEVELS, plus how often it was seen."""
    n = zeros.astype(np.int64) + ones
    odds = np.clip(np.rint(np.log((ones + 0.02) / (zeros + 0.02)) * n / (n + 0.15) * SCALE), -127, 127)
    return (odds * LEVELS + np.searchsorted([1, 2, 4, 8, 16, 64, 512], n, "right")).astype(np.int16)


# ------------------------------------------------------------ mixer

@dataclass
class Mixer:
    weights: np.ndarray         # (gate, predictor)
    power: np.ndarray           # sums of squared gradients
    apm: np.ndarray             # (node, bucket, [zeros, ones])

    @staticmethod
    def new() -> Mixer:
        return Mixer(np.full((GATES, len(ORDERS)), 0.3), np.full((GATES, len(ORDERS)), 1e-4), np.zeros((256, BUCKETS, 2)))

    def mixed(self, tables: list[np.ndarray], d: Decisions):
        """Stored log odds per predictor, gate, and the mixed log odds (steps of 1 / FINE)."""
        raw = [t.take(s) for t, s in zip(tables, d.slots)]
        gate = ((raw[3] & np.int16(LEVELS - 1)) * np.int16(LEVELS) + (raw[2] & np.int16(LEVELS - 1))).astype(np.int64)
        raw = [x >> np.int16(3) for x in raw]
        w = (self.weights.T * (FINE / SCALE)).astype(np.float32)
        z = w[0].take(gate) * raw[0]
        for i in range(1, len(raw)):
            z += w[i].take(gate) * raw[i]
        np.clip(z, -TOP, TOP, out=z)
        return raw, gate, np.rint(z, out=z).astype(np.int32)

    def learn(self, tables: list[np.ndarray], d: Decisions) -> None:
        """One online step: weights against the loss gradient, the map by counting."""
        raw, gate, z = self.mixed(tables, d)
        error = d.bit - 1 / (1 + np.exp(z * np.float32(-1 / FINE)))
        n = np.maximum(np.bincount(gate, minlength=GATES), 1)
        for i, x in enumerate(raw):
            g = np.bincount(gate, error * x, GATES) / (n * SCALE)
            self.power[:, i] += g * g
            self.weights[:, i] += RATE * g / np.sqrt(self.power[:, i])
        cell = (d.node * BUCKETS + bucket(z)) * 2 + d.bit
        self.apm += np.bincount(cell, minlength=self.apm.size).reshape(self.apm.shape)

    def refined(self) -> np.ndarray:
        """Per (node, bucket) the correction in steps, drawn to zero where little was seen."""
        mid = (np.arange(BUCKETS) - (BUCKETS - 1) / 2) / 2
        p = 1 / (1 + np.exp(-mid))
        zeros, ones = self.apm[..., 0], self.apm[..., 1]
        fix = np.log((ones + 16 * p) / (zeros + 16 * (1 - p))) - mid
        return np.rint(0.5 * FINE * fix).astype(np.int32).ravel()

    def cost(self, tables: list[np.ndarray], fix: np.ndarray, d: Decisions) -> np.ndarray:
        """Natural log probability of each decision."""
        _, _, z = self.mixed(tables, d)
        z += fix.take(d.node * np.int32(BUCKETS) + bucket(z)).astype(np.int32)
        np.clip(z, -TOP, TOP, out=z)
        z *= (d.bit * np.int8(2) - np.int8(1))
        return _LOG_P.take(z + TOP)


def bucket(z: np.ndarray) -> np.ndarray:
    """The map's column of a mixed log odds: half units from -8 to 8."""
    return (np.clip(z, -8 * FINE, 8 * FINE) + (8 * FINE + FINE // 4)) // (FINE // 2)


_LOG_P = -np.log1p(np.exp(-np.arange(-TOP, TOP + 1) / FINE))


# ------------------------------------------------------------ passes on Spark

def fold() -> F.Column:
    """crc32 of the id's decimal text, modulo 5; 1 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


_END = mix(np.array([END]))[0]
_ROWS = "o int, block int, cells binary, value double, weight double"


def gather_words(docs: DataFrame) -> DataFrame:
    """(kind, h, c): counts of word hashes (kind 0, the end token among them) and of bytes (kind 1)."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            bytes_, words, ends = np.zeros(256, np.int64), [], 0
            for _, text, at, own, _ in texts_of(data, offs):
                bytes_ += np.bincount(text, minlength=256)
                words.append(own)
                ends += len(at) - 1
            h, c = np.unique(np.concatenate([*words, np.full(ends, _END)]), return_counts=True)
            seen = np.flatnonzero(bytes_)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([0, 1], [len(h), len(seen)]).astype(np.int32)),
                pa.array(np.concatenate([as_long(h), seen])), pa.array(np.concatenate([c, bytes_[seen]]))], ["kind", "h", "c"])

    return docs.select("text").mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def _block_row(o: int, block: int, cells: bytes | None, value: float = 0.0, weight: float = 0.0):
    return pa.RecordBatch.from_arrays([
        pa.array([o], pa.int32()), pa.array([block], pa.int32()), pa.array([cells], pa.binary()), pa.array([value], pa.float64()),
        pa.array([weight], pa.float64())], ["o", "block", "cells", "value", "weight"])


def gather_contexts(docs: DataFrame, code: Code) -> DataFrame:
    """Each task's context counts, by block."""
    def run(batches):
        counts = Counts(code)
        for batch in batches:
            for _, text, at, _, _ in texts_of(*text_bytes(batch.column(0))):
                for part in parts_of(text, at):
                    counts.add(*part)
                    if counts.full():
                        for block in counts.blocks():
                            yield _block_row(*block)
        for block in counts.blocks():
            yield _block_row(*block)

    return docs.select("text").mapInArrow(run, _ROWS)


def learn_mixer(docs: DataFrame, code: Code, tables) -> DataFrame:
    """Each task's context counts, adaptive map (predictor -1) and mixer weights (predictor -2 - gate)."""
    def run(batches):
        counts, mixer = Counts(code), Mixer.new()
        model, seen = tables.value, 0
        for batch in batches:
            for _, text, at, _, _ in texts_of(*text_bytes(batch.column(0))):
                for part in parts_of(text, at):
                    counts.add(*part)
                    if counts.full():
                        for block in counts.blocks():
                            yield _block_row(*block)
                    d = Decisions(*part[:2], code, *part[2:])
                    mixer.learn(model, d)
                    seen += len(d.bit)
        if seen:
            for block in counts.blocks():
                yield _block_row(*block)
            yield _block_row(-1, 0, _pack(mixer.apm.ravel()))
            for g, weights in enumerate(mixer.weights):
                for i, w in enumerate(weights):
                    yield _block_row(-2 - g, i, None, float(w) * seen, float(seen))

    return docs.select("text").mapInArrow(run, _ROWS)


def add_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the same key added up, one after the other: those of ``TOGETHER`` tasks first, then
    their sums, so that no task adds up a block of every task."""
    def run(batches):
        key, total = None, None
        for batch in batches:
            for o, block, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (o, block) != key:
                    if key is not None:
                        yield _block_row(*key, _pack(total))
                    key, total = (o, block), 0
                total = total + _unblock(cells)
        if key is not None:
            yield _block_row(*key, _pack(total))

    own = blocks.where("cells IS NOT NULL").withColumn("group", F.floor(F.spark_partition_id() / TOGETHER))
    some = own.repartition("o", "block", "group").sortWithinPartitions("group", "o", "block").drop("group").mapInArrow(run, _ROWS)
    return some.repartition("o", "block").sortWithinPartitions("o", "block").mapInArrow(run, _ROWS)


def tables_of(blocks: DataFrame) -> list[np.ndarray]:
    """The model's log odds: a fixed number of blocks, turned into bytes before they are collected."""
    def run(batches):
        for batch in batches:
            for o, block, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                both = _unblock(cells)
                odds = log_odds(both[0::2], both[1::2])
                yield pa.RecordBatch.from_arrays([
                    pa.array([o], pa.int32()), pa.array([block], pa.int32()),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(odds.tobytes())], pa.binary())], ["o", "block", "odds"])

    tables = [np.zeros(1 << BITS[o], np.int16) for o in ORDERS]
    half = BLOCK // 2
    for r in blocks.where("o >= 0").mapInArrow(run, "o int, block int, odds binary").toLocalIterator():
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.odds)), np.int16)
        tables[r.o][r.block * half: r.block * half + len(own)] = own
    return tables


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = keep(gather_words(own.where(fold() != 1)), "counts")
    words = learned.where("kind = 0").select("h", "c")
    bytes_ = np.zeros(256, np.int64)
    for r in learned.where("kind = 1").collect():
        bytes_[r.h] = r.c
    code = Code.of(bytes_)
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).head()
    n_all, divisor = int(sums.n), sums.n + 0.5 * (sums.v + 1)

    first = keep(add_blocks(gather_contexts(own.where(fold().isin(2, 3, 4)), code)), "contexts")
    unseen = sc.broadcast(tables_of(first))
    second = keep(learn_mixer(own.where(fold() == 0), code, unseen), "mixer")
    both = keep(add_blocks(first.unionByName(second)), "model")
    mixer = Mixer.new()
    for r in second.where("o < -1").groupBy("o", "block").agg((F.sum("value") / F.sum("weight")).alias("w")).collect():
        mixer.weights[-2 - r.o, r.block] = r.w
    for r in both.where("o = -1").collect():
        mixer.apm = _unblock(bytes(r.cells)).reshape(mixer.apm.shape).astype(np.float64)
    model = sc.broadcast(tables_of(both))
    # the counts' logarithms in steps tell from which count on at most COMMON words remain
    step = F.floor(F.log2("c") * 16).cast("int")
    least, kept = 1 << 30, 0
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True):
        if kept + r["count"] > COMMON:
            break
        least, kept = r.s, kept + r["count"]
    common = words.where(step >= least).collect()
    h = np.array([r.h for r in common], np.int64).view(np.uint64)
    order = np.argsort(h)
    known = sc.broadcast((h[order], np.log10((np.array([r.c for r in common], np.float64)[order] + 0.5) / divisor)))
    fix = mixer.refined()

    def run(batches):
        (common_h, common_log), costs = known.value, Costs(code, model.value, mixer, fix)
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            rid = batch.column(0).to_numpy()
            n = len(batch)
            tokens, seen, base, log_p, size = (np.zeros(n, t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64))
            rare_rid, rare_h = [], []
            for a, text, at, word, first_word in texts_of(data, offs):
                rows = len(at) - 1
                count = np.diff(first_word) + 1
                all_h = np.insert(word, first_word[1:], _END)
                owner = np.repeat(np.arange(a, a + rows), count)
                if len(common_h):
                    k = np.minimum(np.searchsorted(common_h, all_h), len(common_h) - 1)
                    hit = common_h[k] == all_h
                else:
                    k, hit = np.zeros(len(all_h), np.int64), np.zeros(len(all_h), dtype=bool)
                tokens[a: a + rows] = count
                seen += np.bincount(owner[hit], minlength=n)
                base += np.bincount(owner[hit], common_log[k[hit]], n) if hit.any() else 0
                rare_rid.append(rid[owner[~hit]])
                rare_h.append(all_h[~hit])
                size[a: a + rows] = np.diff(at)
                for part, part_offs, skip, carry in parts_of(text, at):
                    run_sum = np.concatenate([[0], np.cumsum(costs.of(part, part_offs, skip, carry))])
                    ends = np.maximum(part_offs - skip, 0)
                    log_p[a: a + rows] += run_sum[ends[1:]] - run_sum[ends[:-1]]
            r = np.concatenate(rare_rid) if rare_rid else np.zeros(0, np.int64)
            w = as_long(np.concatenate(rare_h)) if rare_h else np.zeros(0, np.int64)
            m = len(r)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.array(r)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(w)]),
                pa.concat_arrays([batch.column(1), none]), pa.concat_arrays([pa.array(tokens), none]),
                pa.concat_arrays([pa.array(seen), none]), pa.concat_arrays([pa.array(base), pa.nulls(m, pa.float64())]),
                pa.concat_arrays([pa.array(log_p / np.log(10)), pa.nulls(m, pa.float64())]),
                pa.concat_arrays([pa.array(size), none])],
                ["rid", "h", "doc_id", "n_tokens", "seen", "base", "score", "n_bytes"])

    found = keep(own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        run, "rid long, h long, doc_id long, n_tokens long, seen long, base double, score double, n_bytes long"), "scored")
    # what the common words leave: every occurrence meets its count
    rare = found.where("h IS NOT NULL").select("rid", "h").join(words, "h", "left").groupBy("rid").agg(
        F.count("c").alias("more_seen"),
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(divisor)))).alias("more_base"))
    zero = F.lit(0).cast("long")
    return found.where("h IS NULL").join(rare, "rid", "left").select(
        "doc_id", (fold() == 1).alias("held_out"), "n_tokens", (F.col("seen") + F.coalesce("more_seen", zero)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
