"""Quality rules with cross-document line frequency (operator 6).

Base rules look at one text: words, symbols, repeated lines and words in
repeated 3-word windows. The cross-document rule hashes every normalised line
(ASCII lower case, digits as 0, words joined by one space) and counts, per host
(``source``), the distinct documents that hold it. Any line with a word counts
(``MIN_LINE_WORDS``); one in more than ``MIN_DOCS`` documents is removed, however
large the host is; a document that keeps less than ``MIN_KEPT`` of its words is
depleted and rejected.

A line's documents are counted by partial aggregates. A frequent line meets its
documents over a salted join (``SALTS`` copies of the lines above the limit), so
a line or host that holds a third of all rows is spread out.

Defined results: null text has no words and fails the base rule; a null source
is a host of its own; documents are told apart by row key (id and text), so
repeated rows count once and share their verdict; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import Rolling, doc_groups, hash_words, keep, mix, row_key, text_bytes, word_bounds

MIN_LINE_WORDS = 1
MIN_DOCS = 20
MIN_KEPT = 0.5
SALTS = 32

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _total(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return s[offs[1:]] - s[offs[:-1]]


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text but its repeated lines."""
    n = len(offs) - 1
    starts, ends, first = word_bounds(data, offs)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])       # code points before each byte
    row = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": _total(points[ends] - points[starts], first),
           "n_symbols": _total(_SYMBOL[data], offs)}
    at = np.flatnonzero(np.arange(len(starts)) + 3 <= first[1:][row]) if len(starts) else np.zeros(0, np.int64)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        gram = mix(Rolling(hash_words(data, starts, ends)).run(at, at + 3) + mix(row[at].astype(np.uint64)))
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1)
    out["n_repeat_words"] = _total(np.cumsum(covered)[:-1] > 0, first)
    return out


def _line_hash(line: bytes, min_words: int) -> int | None:
    words = line.translate(_FOLD).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) if len(words) >= max(1, min_words) else None


def text_lines(text: bytes, min_words: int) -> tuple[int, list[tuple[int, int]]]:
    """Number of repeated lines, and (hash, words) of each line of at least ``min_words`` words."""
    seen, again, out = set(), 0, []
    for line in text.split(b"\n"):
        words = line.translate(_FOLD).split()
        if not words:
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        if len(words) >= min_words:
            out.append((xxhash.xxh3_64_intdigest(b" ".join(words)), len(words)))
    return again, out


def measure(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Per row: doc_id, key, source, the base counts, and its lines (hash, n: words, all occurrences)."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(3))
            parts = [base_counts(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]) for a, b in doc_groups(data, offs)]
            counts = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
                      for k in _BASE if k != "n_dup_lines"}
            raw, again, hashes, sizes, ends = data.tobytes(), [], [], [], [0]
            for a, b in zip(offs[:-1], offs[1:]):
                n, lines = text_lines(raw[a:b], min_line_words)
                again.append(n)
                joined: dict[int, int] = {}
                for h, words in lines:
                    joined[h] = joined.get(h, 0) + words
                hashes += joined.keys()
                sizes += joined.values()
                ends.append(len(hashes))
            counts["n_dup_lines"] = np.array(again, np.int64)
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())], ["hash", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 *(pa.array(counts[k].astype(np.int64)) for k in _BASE), lines],
                ["doc_id", "key", "source", *_BASE, "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
                       F.col("source").cast("string").alias("source"), "text").mapInArrow(
        run, "doc_id long, key long, source string, " + ", ".join(f"{k} long" for k in _BASE)
        + ", lines array<struct<hash:long,n:int>>")


def _host() -> F.Column:
    return F.xxhash64("source", F.isnull("source")).alias("host")


def _removed_lines(m: DataFrame, min_docs: int) -> DataFrame:
    """(key, hash, n): the lines above the limit on their host, per document."""
    lines = m.select("key", _host(), F.explode("lines").alias("l")).select("key", "host", "l.hash", "l.n")
    # a document lists a line once; repeated rows meet here
    once = lines.groupBy("host", "hash", "key").agg(F.max("n").alias("n"))
    common = once.groupBy("host", "hash").agg(F.count("*").alias("held")).where(F.col("held") > min_docs)
    salted = keep(common.select("host", "hash"), "common").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(
        salted, ["host", "hash", "salt"]).groupBy("key", "hash").agg(F.max("n").alias("n"))


def verdicts(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_docs: int = MIN_DOCS,
             min_kept: float = MIN_KEPT) -> DataFrame:
    """Per document: base counts, base_failed, n_line_words_removed, kept."""
    m = keep(measure(docs, min_line_words), "lines")
    removed = _removed_lines(m, min_docs).groupBy("key").agg(
        F.sum("n").alias("gone")).withColumnRenamed("key", "rkey")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return m.drop("lines").join(removed, F.col("key") == F.col("rkey"), "left").select(
        "doc_id", "source", *_BASE, failed.alias("base_failed"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_line_words_removed"),
        (~failed & (left >= F.lit(min_kept) * F.col("n_words"))).alias("kept"))


def cleaned(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines above the limit on their host cut from the text (all rows and columns)."""
    removed = _removed_lines(keep(measure(docs, min_line_words), "lines"), min_docs).groupBy("key").agg(
        F.collect_list("hash").alias("__cut")).withColumnRenamed("key", "__key")
    fields = docs.columns
    met = docs.withColumn("__own", row_key()).join(removed, F.col("__own") == F.col("__key"), "left").select(*fields, "__cut")
    at = fields.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(fields)).to_pylist()):
                if cut:
                    gone = {h % (1 << 64) for h in cut}
                    texts.append("\n".join(x for x in text.split("\n") if _line_hash(x.encode(), min_line_words) not in gone))
                else:
                    texts.append(text)
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(cols, fields)

    return met.mapInArrow(run, docs.schema)
