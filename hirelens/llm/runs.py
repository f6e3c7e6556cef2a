"""Periodic runs of words by maximal pairs (operator 12).

A run is a stretch of words with smallest period q and length >= max(``least``, 2q)
that no neighbouring word extends with period q. A pair of word positions (x, x+q)
is *maximal* if the words match for l words from both on, and neither the words
before nor those after them match. Maximal pairs with q <= l and l + q >= ``least``
are exactly the runs (start x, length l + q), so nothing is ever extended.

1. Order. q <= l and l + q >= least give l >= least/2 = ``seed``, so a text in which no
   slice of ``seed`` words occurs twice has no run and is done. The positions of the
   other texts of a batch are sorted together by prefix doubling: by text and ``seed``
   words, then groups of equal slices are split by twice as many words until all differ.
2. Common prefixes of neighbours in that order, from the kept levels, longest first.
3. LCP-interval tree, bottom up with a stack. A node holds the positions below it
   in text order, each with its left-word class (the word before it). When two
   children meet at a node of prefix l, every position of the smaller one looks at
   its next neighbours: if from the larger child, of another class and within l words,
   they form a maximal pair. The nearest ones are enough: an occurrence between x and x+q would
   give the stretch a period smaller than q. Hence each node adds a number of
   candidates linear in its smaller child, O(n log n) in all, and a period that is not
   the smallest is never met (its stretch has a nearer pair deeper in the tree).

There is no shuffle and no state across texts; a batch of up to a mebibyte of texts
is worked on at once (a longer text alone, with memory in proportion to its words).

Defined results: null, empty or blank text has no words, no runs and the digest of
the empty string; repeated rows and null ids stay as they are; extra columns are
ignored; words are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import Rolling, doc_groups, hash_words, mix, ragged, text_bytes, word_bounds

LEAST = 12

Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _with_repeats(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of the texts in which a slice of ``seed`` words occurs twice."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + seed <= first[1:][doc])
    if len(at) < 2:
        return at[:0]
    key = mix(Rolling(words).run(at, at + seed) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    return np.unique(doc[at[by[1:][key[by[1:]] == key[by[:-1]]]]])


def _slice_keys(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, seed: int) -> list[np.ndarray]:
    """Sort keys, least first, of the ``seed`` words from each position (0 beyond the text), then the text."""
    n, bits = len(ids), int(ids.max()).bit_length()
    keys = []
    for a in range(0, seed, 63 // bits):
        key = np.zeros(n, np.int64)
        for k in range(a, min(a + 63 // bits, seed)):
            at = np.arange(k, n + k)
            key = (key << bits) | np.where(at < ends[doc], ids[np.minimum(at, n - 1)], 0)
        keys.append(key)
    return [*keys[::-1], doc]


def _suffix_order(ids: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): all positions sorted by text and the words from there on, and the number of
    words each shares with the one before it (0 where fewer than ``seed``)."""
    n = len(ids)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = first[1:]
    keys = _slice_keys(ids, doc, ends, seed)
    order = np.lexsort(keys)
    start = np.ones(n, dtype=bool)
    start[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    rank = np.full(n + 1, -1, np.int64)                 # the first slot of a position's group; -1 beyond the end
    slot = np.flatnonzero(start)[np.cumsum(start) - 1]
    rank[order] = slot
    live = np.flatnonzero(~(start & np.append(start[1:], True)))    # slots in groups of two or more
    levels, length = [], seed
    while len(live):
        levels.append((length, rank.astype(np.int32) if n < 1 << 31 else rank.copy()))
        at, old = order[live], slot[live]
        second = rank[np.minimum(at + length, n)]
        by = np.lexsort((second, old))
        at, second = at[by], second[by]
        start = np.ones(len(live), dtype=bool)
        start[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        order[live] = at
        slot[live] = live[np.flatnonzero(start)[np.cumsum(start) - 1]]
        rank[at] = slot[live]
        live = live[~(start & np.append(start[1:], True))]
        length *= 2
    # common prefixes of neighbours: greedy over the levels, longest first, then word by word
    x, y = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for length, rank in reversed(levels):
        same = rank[np.minimum(x + lcp, n)] == rank[np.minimum(y + lcp, n)]
        lcp[same & (x + lcp < n) & (y + lcp < n)] += length
    live = np.flatnonzero(lcp > 0)
    stop = np.minimum(ends[doc[x[live]]] - x[live], ends[doc[y[live]]] - y[live])
    for _ in range(seed - 1):
        more = lcp[live] < stop
        live, stop = live[more], stop[more]
        more = ids[x[live] + lcp[live]] == ids[y[live] + lcp[live]]
        live, stop = live[more], stop[more]
        lcp[live] += 1
    return order, np.append(0, lcp)[:n]


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, from the LCP-interval tree bottom up.

    ``left`` is the class of the word before a position (one of its own at a text's start)."""
    out: list[tuple[int, int, int]] = []

    def meet(depth: int, one: list[int], two: list[int]) -> list[int]:
        big, small = (one, two) if len(one) >= len(two) else (two, one)
        n, m = len(big), len(small)
        for k, x in enumerate(small):
            i = bisect_left(big, x)
            if i < n:
                y = big[i]
                q = y - x
                if q <= depth and q + depth >= least and left[x] != left[y] and (k + 1 == m or small[k + 1] > y):
                    out.append((x, depth + q, q))
            if i:
                y = big[i - 1]
                q = x - y
                if q <= depth and q + depth >= least and left[x] != left[y] and (not k or small[k - 1] < y):
                    out.append((y, depth + q, q))
        if m == 1:
            if small[0] > big[-1]:
                big.append(small[0])
            else:
                insort(big, small[0])
        else:
            big += small
            big.sort()
        return big

    depths: list[int] = []
    nodes: list[list[int]] = []
    last = len(order) - 1
    for k, x in enumerate(order):
        here = [x]
        after = lcp[k + 1] if k < last else 0
        while depths and depths[-1] > after:
            here = meet(depths.pop(), nodes.pop(), here)
        if not after:
            continue
        if depths and depths[-1] == after:
            nodes[-1] = meet(after, nodes[-1], here)
        else:
            depths.append(after)
            nodes.append(here)
    return out


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST):
    """Runs of many texts: (text number, start, length, period), by text, start and period.

    ``words`` are word hashes, ``first`` the first word of each text and the end."""
    seed = max(1, (least + 1) // 2)
    own = _with_repeats(words, first, seed)
    if not len(own):
        return (np.zeros(0, np.int64),) * 4
    size = first[own + 1] - first[own]
    begin = np.append(0, np.cumsum(size))
    _, ids = np.unique(words[ragged(first[own], size)], return_inverse=True)
    ids = ids + 1
    order, lcp = _suffix_order(ids, begin, seed)
    left = np.append(0, ids[:-1])
    left[begin[:-1]] = -1
    near = np.flatnonzero((lcp > 0) | np.append(lcp[1:] > 0, False))
    found = maximal_pairs(order[near].tolist(), lcp[near].tolist(), left.tolist(), least)
    runs = np.array(found, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(begin, runs[:, 0], "right") - 1
    return own[text], runs[:, 0] - begin[text], runs[:, 1], runs[:, 2]


def _read_order(ids: list, counts: np.ndarray, rewrite: Rewrite | None) -> np.ndarray:
    """For each word of the batch the word that stands there, as numbers within its text."""
    at = ragged(np.zeros(len(counts), np.int64), counts)
    if rewrite is not None:
        begin = np.cumsum(counts) - counts
        for k in np.flatnonzero(counts):
            tail = rewrite(ids[k], int(counts[k]))
            if tail:
                a, p = tail
                own = at[begin[k] + a: begin[k] + counts[k]]
                own[:] = a + (own - a) % p
    return at


def _apply(docs: DataFrame, least: int, rewrite: Rewrite | None, schema: str, emit) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in doc_groups(data, offs):
                raw = data[offs[a]: offs[b]]
                starts, ends, first = word_bounds(raw, offs[a: b + 1] - offs[a])
                counts = np.diff(first)
                at = _read_order(ids[a:b], counts, rewrite) + np.repeat(first[:-1], counts)
                runs = find_runs(hash_words(raw, starts, ends)[at], first, least)
                yield from emit(ids[a:b], raw, starts[at], ends[at], first, runs)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per run: (doc_id, start, length, period), in word numbers.

    ``rewrite(doc_id, n_words)`` may give (a, p): the text is then read with each word
    i >= a replaced by word a + (i - a) % p."""
    def emit(ids, raw, starts, ends, first, runs):
        text, start, length, period = runs
        if len(text):
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in text.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(period)],
                ["doc_id", "start", "length", "period"])

    return _apply(docs, least, rewrite, "doc_id long, start long, length long, period long", emit)


_SUMMARY = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, ")


def _summary(docs: DataFrame, least: int, rewrite: Rewrite | None, digest: bool) -> DataFrame:
    name = "collapsed_sha256" if digest else "collapsed_text"

    def emit(ids, raw, starts, ends, first, runs):
        text, start, length, period = runs
        held = raw.tobytes()
        cover = np.zeros(first[-1] + 1, np.int64)
        np.add.at(cover, first[text] + start + period, 1)
        np.add.at(cover, first[text] + start + length, -1)
        stays = np.cumsum(cover)[:-1] == 0
        cut = np.searchsorted(text, np.arange(len(ids) + 1))
        cols: list[list] = [[] for _ in range(8)]
        for k in range(len(ids)):
            own = slice(cut[k], cut[k + 1])
            rows = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist()))
            best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
            words = slice(first[k], first[k + 1])
            if rows:
                keep = np.flatnonzero(stays[words]) + first[k]
                kept = b" ".join([held[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
            else:
                kept = b" ".join([held[x:y] for x, y in zip(starts[words].tolist(), ends[words].tolist())])
            listed = "".join("%d,%d,%d\n" % r for r in rows)
            row = (ids[k], len(rows), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                   hashlib.sha256(listed.encode()).hexdigest(),
                   hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            for col, value in zip(cols, row):
                col.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(c, pa.string()) for c in cols[6:]],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", name])

    return _apply(docs, least, rewrite, _SUMMARY + f"{name} string", emit)


def collapse_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """Per text its number of runs, the longest one (ties: smallest start, then period), a digest
    of all, and ``collapsed_text``: of every run only the first period stays."""
    return _summary(docs, least, rewrite, False)


def run_digests(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """As ``collapse_runs`` with a SHA-256 of the collapsed text in its place."""
    return _summary(docs, least, rewrite, True)
