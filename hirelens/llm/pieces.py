"""SentencePiece encoding and decoding with exact N-best segmentations (operator 3).

A text (spaces as U+2581, one put in front) spans a lattice whose edges are the
pieces of a ``.model`` file. The forward Viterbi pass gives the best score of
every prefix; a backward A-star search over the lattice, with those scores as
its exact heuristic, yields segmentations in order of score.

No piece crosses a border between a non-space and a space character, nor one
beside a line break, so a text's lattice falls into independent segments (the
vocabulary is checked for this). Each task keeps a bounded cache of segments;
new ones of a batch are solved together, all of one length at a time, with the
best two scores per prefix. The N best of a whole text can deviate only in the
N - 1 segments with the least loss: those go through A-star, and the sums of
their lists are merged.

Scores: log probabilities of a unigram file as they stand; a BPE file holds merge
ranks, which are turned into normalised Zipf log probabilities of the rank. A
character without a piece gets its byte pieces (or the unknown piece) at the
least score minus 10. Ties go to the longer last piece.

Defined results: null or empty text has no pieces and the single score 0; a text
that holds U+2581 itself decodes to a space there (``round_trip`` is false);
repeated rows and null ids stay as they are; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import SliceTable, by_length, doc_groups, ragged, text_bytes

N_BEST = 3
CACHE = 400_000
GROUP = 4 << 20             # bytes of text whose new segments are solved together
LONG = 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7


class Lattice:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) or "\n" in self.text[i] and len(self.text[i]) > 1 for i in usable):
            raise ValueError(f"{path}: pieces cross words")
        if model.encode(" a  b ", out_type=str) != [*model.encode(" a  b", out_type=str), SPACE] or \
                model.decode(model.encode(" a  b ")) != " a  b ":
            raise ValueError(f"{path}: its normalisation changes white space")
        raw = np.array([model.get_score(i) for i in range(n)])
        self.score = np.full(n, -np.inf)
        ranks = np.array(usable)[np.lexsort((usable, -raw[usable]))]
        if np.array_equal(raw[ranks[:100]], np.round(raw[ranks[:100]])):     # whole numbers: merge ranks
            zipf = -np.log(np.arange(len(ranks)) + ZIPF_SHIFT)
            self.score[ranks] = zipf - np.log(np.exp(zipf).sum())
        else:
            self.score[usable] = raw[usable]
        self.unknown_score = float(self.score[usable].min()) - UNKNOWN_PENALTY
        self.bytes = {i: int(self.text[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.id = {self.text[i]: i for i in usable}
        self.longest = max(map(len, self.id))
        self.table = SliceTable([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.id],
                                np.array(list(self.id.values())))
        own = set(usable)
        shown = [bytes([self.bytes[i]]) if i in self.bytes else self.text[i].replace(SPACE, " ").encode() if i in own
                 else " ⁇ ".encode() if i == self.unknown else b"" for i in range(n)]
        self.shown = shown
        self.shown_len = np.array([len(s) for s in shown])
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.shown_all = np.frombuffer(b"".join(shown), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.best, self.gap = np.zeros(1024), np.zeros(1024)
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.int32), 0
        self.lists: dict[str, list] = {}

    # -------------------------------------------------------- one lattice

    def _fallback(self, char: str) -> tuple[int, ...]:
        own = tuple(self.byte_id.get(b, -1) for b in char.encode())
        return (self.unknown,) if -1 in own else own

    def edges(self, s: str, i: int):
        """(start, ids, score) of the edges that end at i, longest first."""
        for j in range(max(0, i - self.longest), i):
            k = self.id.get(s[j:i])
            if k is not None:
                yield j, (k,), float(self.score[k])
            elif j == i - 1:
                yield j, self._fallback(s[j]), self.unknown_score

    def forward(self, s: str) -> list[float]:
        """Best score of every prefix."""
        out = [0.0]
        for i in range(1, len(s) + 1):
            out.append(max(out[j] + score for j, _, score in self.edges(s, i)))
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a segment, by A-star from its end to its start.

        A state's priority is what its path has lost against the best one (exactly zero along
        best paths, as the same sums are compared); of equal losses the nearest to the start."""
        ahead = self.forward(s)
        order = itertools.count()
        heap = [(0.0, len(s), next(order), None)]
        out = []
        while heap and len(out) < n:
            loss, i, _, path = heapq.heappop(heap)       # path: the pieces taken so far, as a linked list
            if i == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((ahead[-1] - loss, tuple(ids)))
                continue
            for j, own, score in self.edges(s, i):
                heapq.heappush(heap, (loss + (ahead[i] - (ahead[j] + score)), j, next(order), (own, path)))
        return out

    # -------------------------------------------------------- many segments at once

    def _one(self, s: str) -> tuple[float, float, list[int]]:
        two = self.n_best(s, 2)
        return two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, list(two[0][1])

    def _solve(self, rows: np.ndarray, texts: list[str]):
        """Best score, loss of the second best, ids: for segments of one length."""
        n, size = rows.shape
        sums = self.table.sums(rows)
        first, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        start, piece = np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -1, np.int64)
        first[0] = 0
        for i in range(1, size + 1):
            for j in range(max(0, i - self.longest), i):
                k = self.table.find(sums, j, i)
                score = np.where(k >= 0, self.score[k], self.unknown_score if j == i - 1 else -np.inf)
                one, two = first[j] + score, second[j] + score
                better = one > first[i]
                second[i] = np.maximum(np.maximum(second[i], two), np.where(better, first[i], one))
                first[i] = np.where(better, one, first[i])
                start[i][better], piece[i][better] = j, k[better]
        with np.errstate(invalid="ignore"):
            gap = first[size] - second[size]
        out = []
        start, piece = start.T.tolist(), piece.T.tolist()
        for text, s, p in zip(texts, start, piece):
            ids, i = [], size
            while i:
                ids[:0] = (p[i],) if p[i] >= 0 else self._fallback(text[s[i]])
                i = s[i]
            out.append(ids)
        return first[size], np.where(np.isfinite(second[size]), gap, np.inf), out

    def learn(self, segments: list[str]) -> None:
        missing = set(segments).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.clear()
            missing = set(segments)
        if not missing:
            return
        missing = list(missing)
        need = len(self.cache) + len(missing)
        if need > len(self.best):
            grow = max(need, 2 * len(self.best))
            self.best, self.gap, self.at, self.size = (np.resize(x, grow) for x in (self.best, self.gap, self.at, self.size))
        lengths = np.fromiter(map(len, missing), np.int64, len(missing))
        for size, own in by_length(lengths):
            for part in np.split(own, range(10000, len(own), 10000)):
                texts = [missing[k] for k in part]
                if size > LONG:
                    solved = [self._one(t) for t in texts]
                    best, gap, ids = [x[0] for x in solved], [x[1] for x in solved], [x[2] for x in solved]
                else:
                    rows = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), size)
                    best, gap, ids = self._solve(rows, texts)
                k = len(self.cache)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
                if self.used + len(flat) > len(self.ids):
                    self.ids = np.resize(self.ids, max(self.used + len(flat), 2 * len(self.ids)))
                self.ids[self.used: self.used + len(flat)] = flat
                self.best[k: k + len(ids)], self.gap[k: k + len(ids)] = best, gap
                self.size[k: k + len(ids)], self.at[k: k + len(ids)] = sizes, self.used + np.cumsum(sizes) - sizes
                self.used += len(flat)
                self.cache.update(zip(texts, range(k, k + len(ids))))

    def _list(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if len(self.lists) > 100_000:
            self.lists.clear()
        out = self.lists.get(segment)
        if out is None or len(out) < n:
            out = self.lists[segment] = self.n_best(segment, n)
        return out

    # -------------------------------------------------------- texts

    def segments(self, text: str) -> list[str]:
        """The independent parts of a text's lattice."""
        return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _merged(self, parts: list[str], index: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, tuple]]]]:
        """The n best of a text as (loss, [(segment, ids), ...])."""
        gap = self.gap[index]
        near = np.argsort(gap, kind="stable")[: n - 1] if len(gap) <= 4 * n else \
            np.sort(np.argpartition(gap, n - 1)[: n - 1])
        near = [int(k) for k in near if np.isfinite(gap[k])]
        lists = [[(ids_score, k, ids) for ids_score, ids in self._list(parts[k], n)] for k in near]
        out = []
        for pick in itertools.product(*lists):
            loss = sum(own[0][0] - x[0] for own, x in zip(lists, pick))
            out.append((loss, [(x[1], x[2]) for own, x in zip(lists, pick) if x is not own[0]]))
        out.sort(key=lambda x: x[0])
        return out[:n]

    def encode(self, texts: list[str], n: int):
        """For texts: ids (flat), pieces per text, best score, and of each its n best scores and,
        for those after the best, their edits of the best one's ids, the last edit first."""
        parts = [self.segments(t) for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        self.learn(flat)
        index = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([0, *map(len, parts)])
        sizes = self.size[index]
        ids = self.ids[ragged(self.at[index], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        best, scores, coded = [], [], []
        for own, a, b in zip(parts, ends[:-1], ends[1:]):
            top = float(self.best[index[a:b]].sum())
            best.append(top)
            merged = self._merged(own, index[a:b], n)
            scores.append([top - loss for loss, _ in merged])
            coded.append([[self._edit(sizes, total, int(a), own, k, own_ids) for k, own_ids in sorted(changes, reverse=True)]
                          for _, changes in merged[1:]])
        return ids, total[ends], best, scores, coded

    def _edit(self, sizes: np.ndarray, total: np.ndarray, a: int, parts: list[str], k: int, ids: tuple) -> dict:
        """The ids that stand for segment k of a text (whose segments begin at a) instead of its best ones."""
        plain = b"".join([self.shown[i] for i in ids]) == parts[k].replace(SPACE, " ").encode()
        return {"at": int(total[a + k] - total[a]), "n": int(sizes[a + k]), "ids": ids, "plain": plain}

    def text_n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text."""
        parts = self.segments(text)
        self.learn(parts)
        index = np.fromiter(map(self.cache.__getitem__, parts), np.int64, len(parts))
        plain = [tuple(self.ids[self.at[k]: self.at[k] + self.size[k]].tolist()) for k in index]
        out = []
        for loss, changes in self._merged(parts, index, n):
            own = plain.copy()
            for k, ids in changes:
                own[k] = ids
            out.append((float(self.best[index].sum()) - loss, [i for ids in own for i in ids]))
        return out

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """Bytes shown by ids, one text after the other (each with its leading space)."""
        return self.shown_all[ragged(self.shown_at[ids], self.shown_len[ids])]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of many texts (``ends``: where each one's ids end), without their leading space."""
        shown = self.decode_flat(ids).tobytes()
        at = np.concatenate([[0], np.cumsum(self.shown_len[ids])])[ends].tolist()
        return [shown[x: y].removeprefix(b" ") for x, y in zip(at[:-1], at[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as bytes, without the leading space."""
        raw = b"".join(self.shown[i] for i in ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_SEGMENT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The worker's lattice for a file; its cache outlives a batch."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """(doc_id, ids, n_pieces, score, n_best_scores, round_trip, next_best, decoded): the best
    segmentation of every text, the scores of its n best, those after the best as edits of its ids (see
    :func:`n_best_ids`), the text that ``ids`` decode to, and
    whether all of the n best decode to the text."""
    edits = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches):
        model = lattice(path)
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            raw = data.tobytes()
            for a, b in doc_groups(data, offs, GROUP):
                own = [raw[x:y] for x, y in zip(offs[a:b], offs[a + 1: b + 1])]
                ids, ends, best, scores, coded = model.encode([t.decode() for t in own], n)
                shown = model.decoded(ids, ends)
                # the others differ from the best in their edits only
                same = [x == t and all(e["plain"] for edits in alts for e in edits) for x, t, alts in zip(shown, own, coded)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    pa.array(np.diff(ends)), pa.array(best, pa.float64()),
                    pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()),
                    pa.array(coded, edits),
                    pa.array([x.decode("utf-8", "replace") for x in shown], pa.string())],
                    ["doc_id", "ids", "n_pieces", "score", "n_best_scores", "round_trip", "next_best", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_pieces long, score double, n_best_scores array<double>, round_trip boolean, "
             "next_best array<array<struct<at: int, n: int, ids: array<int>>>>, decoded string")


def n_best_ids() -> Column:
    """``array<array<int>>``: the full ids of a coded text's n best segmentations, the best first."""
    def edited(ids: Column, e: Column) -> Column:
        return F.concat(F.slice(ids, F.lit(1), e["at"]), e["ids"], F.slice(ids, e["at"] + e["n"] + 1, F.size(ids)))

    return F.concat(F.array("ids"), F.transform("next_best", lambda edits: F.aggregate(edits, F.col("ids"), edited)))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    def run(batches):
        model = lattice(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
