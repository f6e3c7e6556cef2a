"""Benchmark decontamination by pigeonhole edit matching (operator 7).

Texts and items are normalised alike: bytes A-Z lower-cased, ASCII punctuation
and white space turned into single spaces. An item of m bytes may differ from
the text by k = floor(error_rate * m) edits. It is cut into k + 1 pieces (k + 2
if that is odd): with k edits one piece at least is untouched, so exact piece
hits (one Aho-Corasick pass per text) find every candidate place. By the same
argument one *pair* of neighbouring pieces holds at most one edit, so a hit
counts only if its partner piece stands beside it with at most one edit. Around
the rest, Myers' bit-parallel distance with the whole item as pattern and free
ends in the text decides.

The benchmark is the query set: it is read in blocks of about ``BLOCK_BYTES``
(a block's automaton is what a task holds), each block against all documents.

An item of fewer than ``MIN_BYTES`` bytes would have pieces of a letter or two: it is
searched as a whole, exactly and between word borders.

Defined results: null or empty texts and items never match; every other item is searched;
repeated documents and items each give their rows; null ids stay null; an empty
table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import text_bytes

ERROR_RATE = 0.08
MIN_BYTES = 24
BLOCK_BYTES = 4 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PAIRS = "doc_id long, item_id long, distance int"


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def myers(pattern: bytes, masks: dict[int, int], text: bytes) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


def char_masks(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds every item of a block within its error budget."""

    def __init__(self, items: list[tuple[int | None, bytes]], error_rate: float, min_bytes: int):
        self.items = []
        pieces: dict[str, list[tuple]] = {}
        for item_id, text in items:
            pattern = normalise(text)
            m = len(pattern)
            if not m:
                continue
            if m < min_bytes:
                pieces.setdefault(f" {pattern.decode('latin-1')} ", []).append((len(self.items), -1, 0, b"", None))
                self.items.append((item_id, pattern, 0, None))
                continue
            k = min(math.floor(error_rate * m), m // 2)
            n = k + 1 + (k + 1) % 2
            cuts = [m * i // n for i in range(n + 1)]
            at = len(self.items)
            self.items.append((item_id, pattern, k, char_masks(pattern)))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                other = pattern[cuts[i + 1]: cuts[i + 2]] if i % 2 == 0 else pattern[cuts[i - 1]: a]
                pieces.setdefault(pattern[a:b].decode("latin-1"), []).append((at, a, i % 2, other, char_masks(other)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def match(self, text: bytes) -> list[tuple[int | None, int]]:
        """(item_id, distance) of the items found in a text."""
        if not self.items:
            return []
        norm = b" " + normalise(text) + b" "            # so every word has borders
        spans: dict[int, list[tuple[int, int]]] = {}
        short: set[int] = set()
        for end, (size, places) in self.automaton.iter(norm.decode("latin-1")):
            for at, offset, second, other, masks in places:
                if offset < 0:
                    short.add(at)
                    continue
                start = end + 1 - size
                beside = norm[max(0, start - len(other) - 1): start] if second else norm[end + 1: end + 2 + len(other)]
                if other not in beside and myers(other, masks, beside) > 1:
                    continue
                _, pattern, k, _ = self.items[at]
                start -= offset
                a, b = max(0, start - k), start + len(pattern) + k
                own = spans.setdefault(at, [])
                if own and a <= own[-1][1] and a >= own[-1][0]:
                    own[-1] = (own[-1][0], max(own[-1][1], b))
                else:
                    own.append((a, b))
        found = [(self.items[at][0], 0) for at in sorted(short)]
        for at, places in spans.items():
            item_id, pattern, k, masks = self.items[at]
            best = k + 1
            places.sort()
            joined: list[tuple[int, int]] = []
            for a, b in places:
                if joined and a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], b))
                else:
                    joined.append((a, b))
            if any(pattern in norm[a:b] for a, b in joined):
                best = 0
            else:
                for a, b in joined:
                    best = min(best, myers(pattern, masks, norm[a:b]))
            if best <= k:
                found.append((item_id, best))
        return found


def _blocks(benchmark: DataFrame) -> list[list[tuple[int | None, bytes]]]:
    """The items in blocks of about BLOCK_BYTES, each collected on its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head().n
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r.item_id, r.text.encode()) for r in block.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a benchmark item."""
    sc = docs.sparkSession.sparkContext
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(benchmark):
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, error_rate, min_bytes)
            for batch in batches:
                data, offs = text_bytes(batch.column(1))
                raw, ids = data.tobytes(), batch.column(0).to_pylist()
                rows = [(d, *x) for d, a, b in zip(ids, offs[:-1], offs[1:]) for x in matcher.match(raw[a:b])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32())], ["doc_id", "item_id", "distance"])

        hits = wanted.mapInArrow(run, _PAIRS)
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item (rows without an id are judged
    by their own text like all others)."""
    at = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, ERROR_RATE, MIN_BYTES)
            for batch in batches:
                data, offs = text_bytes(batch.column(at))
                raw = data.tobytes()
                good = np.array([not matcher.match(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])], dtype=bool)
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
