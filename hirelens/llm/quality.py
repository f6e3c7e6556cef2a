"""Quality classifier: histogram gradient-boosted trees over text statistics (operator 4).

The statistics are computed per Arrow batch from hashed words and byte classes.
Training happens on the driver from a bounded sample (``MAX_LABELLED`` labelled
rows, chosen by a hash of their id): features are cut into quantile bins, trees
of fixed depth are grown from gradient histograms, and the model is flattened
into arrays, which every task traverses with numpy for a whole batch at once.

Defined results: null or empty text has all statistics zero and gets a score like
any other; rows with a null id are scored and never learned from; null labels
are ignored; without labels of both classes the score is the smoothed share of
label 1 (0.5 without labels); repeated rows get equal scores; extra columns are
passed through by ``with_score`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import Rolling, doc_groups, hash_words, mix, text_bytes, word_bounds

MAX_LABELLED = 20000
THRESHOLD = 0.3
BINS, DEPTH, ROUNDS, RATE, L2 = 64, 4, 60, 0.2, 1.0

FEATURES = ("log_words", "mean_word_bytes", "mean_line_words", "symbols", "upper", "digits", "bars", "bangs", "wide",
            "distinct_words", "top_word", "repeated_trigrams", "repeated_lines", "stop_end")

_CLASS = {name: np.zeros(256, np.uint8) for name in ("symbols", "upper", "digits", "bars", "bangs", "wide", "lines")}
_CLASS["symbols"][[ord(c) for c in "#*$%&<>{}[]\\^~=@_+/"]] = 1
_CLASS["upper"][65:91] = 1
_CLASS["digits"][48:58] = 1
_CLASS["bars"][ord("|")] = 1
_CLASS["bangs"][ord("!")] = 1
_CLASS["wide"][128:] = 1
_CLASS["lines"][ord("\n")] = 1


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each slice [offs[i], offs[i+1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def _distinct(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct keys, and the count of the commonest one."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    packed = np.sort((row.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    owner = (packed[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(new, len(packed))))
    return np.bincount(owner, minlength=n).astype(np.float64), top


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(offs) - 1
    starts, ends, first = word_bounds(data, offs)
    words = hash_words(data, starts, ends)
    count = np.diff(first).astype(np.float64)
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    some = np.maximum(count, 1)
    row = np.repeat(np.arange(n), np.diff(first))
    share = {k: _sums(t[data], offs) for k, t in _CLASS.items()}
    distinct, top = _distinct(words, row, n)
    grams = np.maximum(np.diff(first) - 2, 0)
    if grams.sum():
        at = np.flatnonzero(np.arange(len(words)) + 3 <= first[1:][row])
        tri, _ = _distinct(Rolling(words).run(at, at + 3), row[at], n)
    else:
        tri = np.zeros(n)
    cut = np.flatnonzero(np.concatenate([data == 10, [False]]))
    line_start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut[cut + 1 < len(data)] + 1])).astype(np.int64)
    line_first = np.append(np.searchsorted(starts, line_start), len(words))
    full = np.flatnonzero(np.diff(line_first) > 0)
    line_row = row[line_first[full]] if len(full) else np.zeros(0, np.int64)
    if len(full):
        text = Rolling(words).run(line_first[full], line_first[full + 1])
        lines, _ = _distinct(mix(text), line_row, n)
    else:
        lines = np.zeros(n)
    n_lines = np.bincount(line_row, minlength=n).astype(np.float64)
    last = data[ends - 1] if len(ends) else data[:0]
    stops = _sums(np.isin(last, [ord(c) for c in ".?!:;"]), first)
    return np.column_stack([
        np.log1p(count), _sums(ends - starts, first) / some, count / np.maximum(n_lines, 1),
        share["symbols"] / size, share["upper"] / size, share["digits"] / size, share["bars"] / size,
        share["bangs"] / size, share["wide"] / size, distinct / some, top / some,
        1 - tri / np.maximum(grams, 1), 1 - lines / np.maximum(n_lines, 1), stops / some])


# ------------------------------------------------------------ model

@dataclass
class Trees:
    """Complete binary trees as arrays: inner nodes (tree, 2^depth - 1), leaves (tree, 2^depth)."""
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, rounds: int = ROUNDS, weight: np.ndarray | None = None) -> Trees:
    """Newton boosting for log loss on quantile-binned features; ``weight``: how often each row stands."""
    w = np.ones(len(y)) if weight is None else weight
    ones = float((w * y).sum())
    share = (ones + 1) / (float(w.sum()) + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2 ** depth - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not 0 < ones < float(w.sum()):
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z = np.full(len(y), base)
    feats, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = w * (p - y), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k, off = 2 ** level, 2 ** level - 1
            at = node - off
            gain = np.full((k, x.shape[1]), -np.inf)
            split = np.zeros((k, x.shape[1]), np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = len(e) + 1
                gs = np.bincount(at * b + binned[:, j], g, k * b).reshape(k, b).cumsum(axis=1)
                hs = np.bincount(at * b + binned[:, j], h, k * b).reshape(k, b).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs[:, :-1] ** 2 / (hs[:, :-1] + L2) + (gt - gs[:, :-1]) ** 2 / (ht - hs[:, :-1] + L2) - gt ** 2 / (ht + L2)
                value[(hs[:, :-1] < 1e-3) | (ht - hs[:, :-1] < 1e-3)] = -np.inf
                split[:, j] = value.argmax(axis=1)
                gain[:, j] = value.max(axis=1)
            best = gain.argmax(axis=1)
            for i in range(k):
                if gain[i, best[i]] > 1e-6:
                    feat[off + i], cut[off + i] = best[i], edges[best[i]][split[i, best[i]]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feat[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        z += leaf[at]
        feats.append(feat), cuts.append(cut), leaves.append(leaf)
    return Trees(base, np.array(feats), np.array(cuts), np.array(leaves))


# ------------------------------------------------------------ on Spark

def fold() -> F.Column:
    """crc32 of the id's decimal text (of the empty text without an id), modulo 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def _batch_statistics(col) -> np.ndarray:
    data, offs = text_bytes(col)
    parts = [statistics(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]) for a, b in doc_groups(data, offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IN (0, 1)").where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

    def run(batches):
        for batch in batches:
            x = _batch_statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select(
        "text", "y").mapInArrow(run, "x array<double>, y int")
    rows = learn.collect()      # bounded by ``most`` (times the copies of an id)
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r.y for r in rows], np.float64)
    order = np.lexsort((*x.T, y))       # the model doesn't depend on the order of the rows
    return fit(x[order], y[order])


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of its text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            score = model.score(_batch_statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    return with_score(docs, train(docs, labels), "__score").where(F.col("__score") >= THRESHOLD).drop("__score")
