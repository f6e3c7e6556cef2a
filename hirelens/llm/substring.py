"""Exact substring deduplication by seed and extend (operator 9).

A *window* is ``length`` consecutive words of one text; each word covered by a
window that also starts elsewhere (same text included) is removed.

1. Seeds. Winnowing picks in every window its least k-gram (ties: leftmost), so
   equal windows have equal seeds at equal offsets. The windows of one seed form
   a range; its *extension* is the word run from the first window's start to the
   last one's end. A seed row holds (seed hash, extension hash, text, range).
2. Join on seeds. A seed that occurs once cannot lie in a repeated window.
3. Extend both ways. Occurrences with the same extension repeat as a whole: all
   their windows go. A seed with several extensions sends one representative
   per extension to the window level, where every offset (d words to the left,
   the rest to the right) is one 96-bit key; equal keys are repeats.
4. Removed ranges are united per text (maximal repeats) and the rest is kept.

No step pairs the members of a group: work is linear in the occurrences, group
sizes are partial aggregates, and a text's own ranges are all that meets in one
row. Texts travel zstd-packed.

Defined results: null or empty text has no words and digest of the empty string;
repeated rows count as separate occurrences of the same text; null ids and extra
columns are allowed; a text shorter than ``length`` words keeps everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import Rolling, as_long, doc_groups, hash_words, keep, mix, ragged, row_key, text_bytes, word_bounds

LENGTH = 35
SEED_WORDS = 6
_POS = np.uint64((1 << 28) - 1)
_SEED = "seed long, ext long, key long, lo int, n int"


def _window_seeds(gram: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` k-grams the position of the least one, leftmost on ties."""
    at = np.arange(len(gram), dtype=np.uint64)
    low = (gram & ~_POS) | (at & _POS)
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done:])
    return (low & _POS).astype(np.int64)


def _windows(data: np.ndarray, offs: np.ndarray, length: int, seed_words: int):
    """Word hashes, first words per text, valid window starts, their seeds, their texts."""
    starts, ends, first = word_bounds(data, offs)
    words = hash_words(data, starts, ends)
    counts = np.diff(first)
    many = np.maximum(counts - length + 1, 0)
    begin = ragged(first[:-1], many)
    if not len(begin):
        return words, first, begin, begin, begin, None
    roll = Rolling(words)
    at = np.arange(len(words) - seed_words + 1)
    seeds = _window_seeds(roll.run(at, at + seed_words), length - seed_words + 1)
    return words, first, begin, seeds[begin], np.repeat(np.arange(len(counts)), many), roll


def seeds(docs: DataFrame, length: int, seed_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for a, b in doc_groups(data, offs):
                words, first, begin, seed, text, roll = _windows(
                    data[offs[a]: offs[b]], offs[a: b + 1] - offs[a], length, seed_words)
                if not len(begin):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]))
                n = np.diff(np.append(new, len(begin)))
                s, lo = seed[new], begin[new]
                # the extension's hash also holds the seed's place in it
                ext = mix(roll.run(lo, lo + n + length - 1) + (s - lo).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(as_long(roll.run(s, s + seed_words))), pa.array(as_long(ext)),
                    pa.array(keys[a + text[new]]), pa.array((lo - first[text[new]]).astype(np.int32)),
                    pa.array(n.astype(np.int32))], ["seed", "ext", "key", "lo", "n"])

    return docs.select("key", "text").mapInArrow(run, _SEED)


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            raw = [pack.compress(data[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())],
                                             ["key", "doc_id", "packed"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, packed binary")


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def _ranges(col) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = col.to_pylist()
    return [(np.array([x["lo"] for x in r or ()], np.int64), np.array([x["n"] for x in r or ()], np.int64)) for r in lists]


def window_keys(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Every window of the representative ranges: (w1, w2, key, lo)."""
    wanted = reps.groupBy("key").agg(F.collect_set(F.struct("lo", "n")).alias("ranges")).withColumnRenamed("key", "rkey")

    def run(batches):
        for batch in batches:
            for key, raw, (lo, n) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _ranges(batch.column(2))):
                data = _unpack(raw)
                starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                words = hash_words(data, starts, ends)
                begin = np.unique(ragged(lo, n))
                w1 = Rolling(words).run(begin, begin + length)
                w2 = Rolling(mix(words + np.uint64(77)), 0x2545F4914F6CDD1D).run(begin, begin + length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(as_long(w1)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(np.full(len(begin), key, np.int64)), pa.array(begin.astype(np.int32))], ["w1", "w2", "key", "lo"])

    texts = _packed(docs)
    return texts.join(wanted, texts.key == wanted.rkey).select("key", "packed", "ranges").mapInArrow(
        run, "w1 long, w2 int, key long, lo int")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """(key, lo, n): windows lo .. lo+n-1 of the text with that key are repeated.

    ``docs`` has key (``row_key``), doc_id and text."""
    found = seeds(docs, length, seed_words)
    groups = keep(found.groupBy("seed").agg(
        F.count("*").alias("c"), (F.min("ext") != F.max("ext")).alias("several")).where("c > 1").drop("c"), "seeds")
    hits = keep(found.join(groups, "seed"), "hits")
    whole = hits.where("NOT several").select("key", "lo", "n")
    mixed = hits.where("several")
    variants = keep(mixed.groupBy("seed", "ext").agg(
        F.count("*").alias("c"), F.min(F.struct("key", "lo", "n")).alias("rep")), "variants")
    same = mixed.join(variants.where("c > 1").select("seed", "ext"), ["seed", "ext"]).select("key", "lo", "n")
    wins = keep(window_keys(docs, variants.select("rep.*"), length), "windows")
    again = keep(wins.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    part = wins.join(again, ["w1", "w2"]).select("key", "lo", F.lit(1).alias("n"))
    return whole.unionByName(same).unionByName(part)


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the text without repeated passages."""
    return _apply(docs, length, seed_words, False)


def _apply(docs: DataFrame, length: int, seed_words: int, digest: bool) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    ranges = repeated_ranges(keyed, length, seed_words).groupBy("key").agg(
        F.collect_list(F.struct("lo", "n")).alias("ranges")).withColumnRenamed("key", "rkey")

    def run(batches):
        for batch in batches:
            total, gone, out = [], [], []
            for raw, (lo, n) in zip(batch.column(1).to_pylist(), _ranges(batch.column(2))):
                words = zstandard.ZstdDecompressor().decompress(raw).split()
                if len(lo):
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, lo, 1)
                    np.add.at(delta, lo + n + length - 1, -1)
                    stay = np.cumsum(delta)[:-1] == 0
                    kept = [words[i] for i in np.flatnonzero(stay)]
                else:
                    kept = words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                text = b" ".join(kept)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept_text"
    texts = _packed(keyed)
    return texts.join(ranges, texts.key == ranges.rkey, "left").select("doc_id", "packed", "ranges").mapInArrow(
        run, f"doc_id long, n_words long, n_removed long, {name} string")


def substring_digest(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """As ``substring_dedup`` with a SHA-256 of the kept words in place of the text."""
    return _apply(docs, length, seed_words, True)
