"""Alignment of two tokenizers over the same texts, divide and conquer at shared cuts (operator 13).

Tokenizer A is a byte-level BPE file (a space is put before the text), B a SentencePiece
file that puts that space itself; special tokens' strings are plain text. Tokens of both
cover the same bytes; where a token of A and one of B end at the same byte, a *cut* is shared.

Divide and conquer: a text is an interval of A's and of B's tokens. In each interval
the end of A's middle token is looked up among B's ends by bisect, then its neighbours
outwards, until a shared one is found; both halves are treated alike. An interval without
a shared end inside is a *group*: the smallest aligned unit. All intervals of a
batch of texts take their steps together, so a level is a few array operations.

No token of either kind holds a space behind another character, so a single space between
two other characters always starts a new token of both. Texts are cut there into *units*
(words, mostly); a unit is encoded, aligned and its pairs are counted once per worker,
and kept in a cache of bounded size. A text's result is put together from its units.

Links are all A-B pairs of token occurrences in one group; they are counted per distinct
unit and pair of ids, never listed. Over the corpus each id pair has the number
of documents that link it:

1. ``pair_documents``: distinct pairs of each document, summed per task, then by Spark.
2. ``aligned``: each document's links get their pairs' counts. The most common pairs (at
   most ``COMMON``, by a histogram of counts) and the highest count of each A id (at most
   the vocabulary) are sent to the tasks; all rarer pairs are joined, so that no
   join key has more rows than the threshold and no task holds the whole table.

Defined results: null and empty texts, and texts whose joined token bytes are not a space
and the text, have no tokens: zeros, and '' in place of the digest. Repeated rows and null ids
stay as they are and count as documents; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import doc_groups, keep, ragged, text_bytes

COMMON = 1 << 20                # pairs sent to every task at most (16 bytes each)
UNITS = 600_000                 # units that a worker's cache holds at most, and
UNIT_PAIRS = 6_000_000          # their distinct pairs (a unit beyond both stands alone in it)
_HELD = 1 << 22                 # pairs a task sums up before it hands them on
_GROUP = 4 << 20                # bytes of texts worked on at once


# ------------------------------------------------------------ tokenizers

def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Entries:
    """Bytes of a vocabulary's entries by id."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def __len__(self) -> int:
        return len(self.size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.size[ids])]


class ByteBPE:
    """A byte-level BPE file: ids of texts, special strings treated as plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [bytes(letters[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part) for m in model["merges"]]
        if [ranks[m] for m in made] != list(range(ranks[made[0]], ranks[made[0]] + len(made))):
            raise ValueError(f"{path}: ids are not in the order of merges")
        entries = [b""] * (max([*ranks.values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1)
        for token, i in ranks.items():
            entries[i] = token
        self.entries = Entries(entries)
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A SentencePiece file: ids of texts and the pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.entries = Entries([
            bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)])

        # a space (as U+2581) behind another character would let tokens cross the cuts between units
        self.cuts = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(n) if not self.model.is_control(i))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _offsets(lists: list[list]) -> np.ndarray:
    offs = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offs[1:])
    return offs


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offs = _offsets(lists)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(offs[-1])), offs


def _same_bytes(entries: Entries, ids: np.ndarray, offs: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each text's tokens join to its bytes (``data`` cut at ``begin``)."""
    total = np.concatenate([[0], np.cumsum(entries.size[ids])])[offs]
    fits = np.diff(total) == np.diff(begin)
    text = np.repeat(np.arange(len(fits)), np.diff(offs))
    inside = ragged(begin[:-1][fits], np.diff(begin)[fits])
    wrong = entries.joined(ids[fits[text]]) != data[inside]
    bad = np.searchsorted(begin, inside[wrong], "right") - 1
    fits[bad] = False
    return fits


def _cut_at(entries: Entries, ids: np.ndarray, begin: np.ndarray) -> np.ndarray | None:
    """First tokens of the parts that start at the given bytes, if tokens end there and sizes agree."""
    ends = np.append(0, np.cumsum(entries.size[ids]))
    at = np.searchsorted(ends, begin)
    return at if ends[-1] == begin[-1] and np.array_equal(ends[at], begin) else None


def encode_both(a: ByteBPE, b: Pieces, units: list[str], texts: list[str]):
    """(ids, offsets) under A and B, and whether the bytes come back (what does not has no tokens).

    ``units`` have no blank at either end: joined by spaces they are encoded in one call, in
    which tokens end where units do. ``texts`` are encoded one by one."""
    raw = [b" " + t.encode() if t else b"" for t in chain(units, texts)]
    begin = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=begin[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    sides = []
    for k in (a, b):
        blocks = []
        for x in range(0, len(units), 4096):
            own = units[x: x + 4096]
            ids = np.array(k.ids([" ".join(own)])[0], np.int64)
            at = _cut_at(k.entries, ids, begin[x: x + len(own) + 1] - begin[x])
            blocks.append((ids, at) if at is not None else _joined(k.ids(own)))     # some unit's bytes do not come back
        if texts:
            blocks.append(_joined([y if t else [] for y, t in zip(k.ids(texts), texts)]))
        ids = np.concatenate([i for i, _ in blocks]) if blocks else np.zeros(0, np.int64)
        offs = np.concatenate([[0], *[np.diff(o) for _, o in blocks]]).cumsum().astype(np.int64)
        sides.append((ids, offs))
    fits = np.logical_and(*(_same_bytes(k.entries, *side, data, begin) for k, side in zip((a, b), sides)))
    out = []
    for ids, offs in sides:
        own = np.repeat(fits, np.diff(offs))
        out += [ids[own], np.concatenate([[0], np.cumsum(np.where(fits, np.diff(offs), 0))])]
    return *out, fits


# ------------------------------------------------------------ divide and conquer

def shared_groups(a_end: np.ndarray, b_end: np.ndarray, a_offs: np.ndarray, b_offs: np.ndarray, near: int = 6):
    """Groups of many texts in order: (a_lo, a_hi, b_lo, b_hi) token ranges.

    ``a_end``, ``b_end`` are the byte ends of all tokens, rising through the batch; ``a_offs``,
    ``b_offs`` the first tokens of the texts. ``near`` neighbours are tried one by one before
    the rest of an interval is looked up at once."""
    some = np.diff(a_offs) > 0
    work = np.stack([a_offs[:-1][some], a_offs[1:][some], b_offs[:-1][some], b_offs[1:][some]])
    done = []
    while work.shape[1]:
        single = (work[1] - work[0] == 1) | (work[3] - work[2] == 1)
        done.append(work[:, single])
        work = work[:, ~single]
        a_lo, a_hi = work[0], work[1]
        middle = (a_lo + a_hi - 2) >> 1                 # ends inside: those of tokens a_lo .. a_hi - 2
        cut = np.full(len(middle), -1)
        open_ = np.arange(len(middle))
        for step in range(near):
            for at in ((middle[open_],) if not step else (middle[open_] - step, middle[open_] + step)):
                inside = (at >= a_lo[open_]) & (at <= a_hi[open_] - 2) & (cut[open_] < 0)
                end = a_end[np.where(inside, at, 0)]
                place = np.searchsorted(b_end, end)
                hit = inside & (b_end[np.minimum(place, len(b_end) - 1)] == end)
                cut[open_[hit]] = at[hit]
            open_ = open_[cut[open_] < 0]
            if not len(open_):
                break
        wide = open_[(a_hi - a_lo)[open_] > near]
        if len(wide):
            size = a_hi[wide] - 1 - a_lo[wide]
            at = ragged(a_lo[wide], size)
            own = np.repeat(np.arange(len(wide)), size)
            place = np.searchsorted(b_end, a_end[at])
            hit = b_end[np.minimum(place, len(b_end) - 1)] == a_end[at]
            at, own = at[hit], own[hit]
            by = np.lexsort((np.abs(at - middle[wide][own]), own))
            first = by[np.unique(own[by], return_index=True)[1]]
            cut[wide[own[first]]] = at[first]
        whole = cut < 0
        done.append(work[:, whole])
        work, cut = work[:, ~whole], cut[~whole]
        b_cut = np.searchsorted(b_end, a_end[cut]) if len(cut) else cut
        work = np.concatenate([np.stack([work[0], cut + 1, work[2], b_cut + 1]),
                               np.stack([cut + 1, work[1], b_cut + 1, work[3]])], axis=1)
    groups = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
    return groups[:, np.argsort(groups[0], kind="stable")]


def align(a: ByteBPE, b: Pieces, a_ids, a_offs, b_ids, b_offs):
    """The groups of a batch of encoded texts, and the first group of each text."""
    groups = shared_groups(np.cumsum(a.entries.size[a_ids]), np.cumsum(b.entries.size[b_ids]), a_offs, b_offs)
    return groups, np.searchsorted(groups[0], a_offs)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    text = [str(i).encode() for i in range(n)]
    return (np.frombuffer(b"".join(t.ljust(10, b"\0") for t in text), np.uint8).reshape(n, 10),
            np.array([len(t) for t in text], np.int64))


_decimal: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_strings(n_ids: int, a_ids, b_ids, groups, first) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    if n_ids not in _decimal:
        _decimal[n_ids] = _digits(n_ids)
    digits, sizes = _decimal[n_ids]
    a_lo, a_hi, b_lo, b_hi = groups
    n_a, n_b = a_hi - a_lo, b_hi - b_lo
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    a_at = np.arange(len(a_ids)) + np.repeat(b_lo, n_a)
    b_at = np.arange(len(b_ids)) + np.repeat(a_hi, n_b)
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_hi - 1 + b_lo] = ord("|")
    mark[b_hi - 1 + a_hi] = ord(";")
    size = sizes[ids]
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        out[begin[own] + k] = digits[ids[own], k]
    out[ends - 1] = mark
    raw = out.tobytes()
    bound = np.append(0, ends)[np.append(a_lo, len(a_ids))[first] + np.append(b_lo, len(b_ids))[first]].tolist()
    return [raw[x: y - 1] if y > x else b"" for x, y in zip(bound[:-1], bound[1:])]


# ------------------------------------------------------------ links

def _counted(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Distinct ids of each range with their number: (range, id, number), by range."""
    n = hi - lo
    own = np.repeat(np.arange(len(lo)), n)
    key = own * (1 << 32) + ids[ragged(lo, n)]
    key, number = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, number


def pairs_of(a_ids, b_ids, groups, n_b: int):
    """(group, pair, links): the distinct id pairs of each group, a * n_b + b."""
    a_lo, a_hi, b_lo, b_hi = groups
    ga, ia, ma = _counted(a_ids, a_lo, a_hi)
    gb, ib, mb = _counted(b_ids, b_lo, b_hi)
    first_b = np.searchsorted(gb, np.arange(groups.shape[1] + 1))
    many = np.diff(first_b)[ga]                         # partners of each distinct A id
    left = np.repeat(np.arange(len(ga)), many)
    right = ragged(first_b[ga], many)
    return ga[left], ia[left] * n_b + ib[right], ma[left] * mb[right]


def _summed(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed values; without values the keys are sorted and counted."""
    if values is not None:
        by = np.argsort(keys, kind="stable")
        keys, values = keys[by], values[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.diff(np.append(new, len(keys))) if values is None else np.add.reduceat(values, new)


# ------------------------------------------------------------ units

class _Column:
    """A numpy column that grows at its end."""

    def __init__(self, kind=np.int64):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(self.n, len(values)) + 1024, self.held.dtype)])
        self.held[self.n: self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Units:
    """The worker's tokenizers and what it knows of the units it has met."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a, self.b = ByteBPE(a_path, pattern), Pieces(b_path)
        self.n_b = len(self.b.entries)
        self.span = len(self.a.entries) * self.n_b
        self.n_ids = max(len(self.a.entries), self.n_b)
        self.counts = None                              # (pairs, counts, highest by A id), once known; groups are shown then
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.n_a, self.n_b_, self.n_groups, self.n_links = (_Column() for _ in range(4))
        self.fits = _Column(bool)
        self.first_pair, self.pair, self.links = _Column(), _Column(), _Column()
        self.first_pair.add(np.zeros(1, np.int64))
        self.n_best, self.count_sum, self.rare = _Column(), _Column(), _Column(bool)

    def know(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        """From now on units are learnt with the counts of their pairs."""
        if self.counts is None or self.counts[0] is not pairs:
            self.counts = pairs, counts, best
            self.clear()

    def of(self, texts: list[str], distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers, offsets) of texts; an empty text has no units. ``distinct``: each once, in any order."""
        if len(self.number) > UNITS or self.pair.n > UNIT_PAIRS:
            self.clear()
        if not self.b.cuts:
            split = [[" " + t] if t else [] for t in texts]
            return self._numbers(list(chain.from_iterable(split))), _offsets(split)
        split = [t.split(" ") if t else [] for t in texts]
        if distinct:
            split = list(map(list, map(set, split)))
        flat, offs = list(chain.from_iterable(split)), _offsets(split)
        number = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0)
        # a blank beside a cut is no cut, as the space may belong to it; such units are never known
        odd = [i for i in missing.tolist() if not flat[i] or flat[i][0].isspace() or flat[i][-1].isspace()]
        again = np.unique(np.searchsorted(offs, odd, "right") - 1).tolist()
        parts, at = [], 0
        for k in [*again, len(texts)]:                  # the texts between those to be cut anew stay
            s, e = offs[at], offs[k]
            here = missing[np.searchsorted(missing, s): np.searchsorted(missing, e)]
            number[here] = self._numbers([flat[i] for i in here.tolist()])
            parts.append(number[s:e])
            if k < len(texts):
                split[k] = [" " + u for u in _CUT.split(texts[k])]      # no plain unit starts like this
                if distinct:
                    split[k] = list(set(split[k]))
                parts.append(self._numbers(split[k]))
            at = k + 1
        return np.concatenate(parts), _offsets(split) if again else offs

    def _numbers(self, units: list[str]) -> np.ndarray:
        known = self.number
        new = {u for u in units if u not in known}
        if new:
            plain, odd = [u for u in new if u[0] != " "], [u for u in new if u[0] == " "]
            self._learn(plain, odd)
            known.update(zip(plain + odd, range(len(known), len(known) + len(new))))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """``odd`` ones stand after a space that is no part of them."""
        units = plain + odd
        a_ids, a_offs, b_ids, b_offs, fits = encode_both(self.a, self.b, plain, [u[1:] for u in odd])
        groups, first = align(self.a, self.b, a_ids, a_offs, b_ids, b_offs)
        if self.counts is not None:
            self.shown += group_strings(self.n_ids, a_ids, b_ids, groups, first)
        links = np.append(0, np.cumsum((groups[1] - groups[0]) * (groups[3] - groups[2])))
        for column, values in ((self.n_a, np.diff(a_offs)), (self.n_b_, np.diff(b_offs)), (self.n_groups, np.diff(first)),
                               (self.n_links, np.diff(links[first])), (self.fits, fits)):
            column.add(values)
        group, pair, times = pairs_of(a_ids, b_ids, groups, self.n_b)
        unit = (np.searchsorted(first, group, "right") - 1)
        by = np.lexsort((pair, unit))
        unit, pair, times = unit[by], pair[by], times[by]
        new = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])])) if len(pair) else by
        times = np.add.reduceat(times, new) if len(new) else times
        unit, pair = unit[new], pair[new]
        base = self.pair.n
        self.pair.add(pair)
        self.links.add(times)
        self.first_pair.add(base + np.searchsorted(unit, np.arange(1, len(units) + 1)))
        if self.counts is not None:
            known, counts, best = self.counts
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), dtype=bool)
            n = np.where(hit, counts[at] if len(known) else 0, 0)
            sums = np.zeros((3, len(units)), np.int64)
            np.add.at(sums[0], unit, np.where(hit & (n == best[pair // self.n_b]), times, 0))
            np.add.at(sums[1], unit, n * times)
            np.add.at(sums[2], unit, ~hit)
            for column, values in ((self.n_best, sums[0]), (self.count_sum, sums[1]), (self.rare, sums[2] > 0)):
                column.add(values)

    def fitting(self, units: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the units of texts of which some unit's bytes do not come back."""
        text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        bad = np.bincount(text[~self.fits.all[units]], minlength=len(offs) - 1) > 0
        stay = ~bad[text]
        return units[stay], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(offs)))])


_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple, Units] = {}


def loaded(a_path: str, pattern: str, b_path: str) -> Units:
    if (a_path, pattern, b_path) not in _loaded:
        _loaded[a_path, pattern, b_path] = Units(a_path, pattern, b_path)
    return _loaded[a_path, pattern, b_path]


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[offs[1:]] - total[offs[:-1]]


# ------------------------------------------------------------ tables

def _groups_of_texts(batch):
    """(first row, texts) of a batch of (doc_id, text), of bounded bytes."""
    data, offs = text_bytes(batch.column(1))
    raw = data.tobytes()
    for x, y in doc_groups(data, offs, _GROUP):
        yield x, [raw[s:e].decode() for s, e in zip(offs[x:y], offs[x + 1: y + 1])]


def groups(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """(doc_id, groups): the aligned token groups of every document, in order."""
    def run(batches):
        units = loaded(a_path, pattern, b_path)
        a, b = units.a, units.b
        for batch in batches:
            for x, texts in _groups_of_texts(batch):
                a_ids, a_offs, b_ids, b_offs, _ = encode_both(a, b, [], texts)
                found, first = align(a, b, a_ids, a_offs, b_ids, b_offs)
                sides = [pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                         for lo, ids in ((found[0], a_ids), (found[2], b_ids))]
                both = pa.StructArray.from_arrays(sides, ["a", "b"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(x, len(texts)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), both)], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def pair_documents(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """(pair, n): the number of documents that link each pair of ids, pair = a * size of B + b."""
    def run(batches):
        units = loaded(a_path, pattern, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed_on():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            for x in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[x: x + (1 << 18)]), pa.array(counts[x: x + (1 << 18)])], ["pair", "n"])

        for batch in batches:
            for _, texts in _groups_of_texts(batch):
                own, offs = units.fitting(*units.of(texts, True))
                text = np.repeat(np.arange(len(texts)), np.diff(offs))
                first, n = units.first_pair.all, len(texts)
                x = 0
                while x < len(own):                             # blocks of whole texts
                    y = x + int(np.searchsorted(text[x:], text[min(x + (1 << 18), len(own)) - 1], "right"))
                    many = np.diff(first)[own[x:y]]
                    marks = units.pair.all[ragged(first[own[x:y]], many)] * n + np.repeat(text[x:y], many)
                    held.append(_summed(np.unique(marks) // n, None))
                    x = y
                if sum(len(k) for k, _ in held) > _HELD:
                    held[:] = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > _HELD // 2:
                        yield from handed_on()
        if held:
            yield from handed_on()

    return _texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _threshold(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs' counts reach (64 rows come to the driver)."""
    rows = pairs.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()
    total, least = 0, 1 << 62
    for k, c in sorted(((r["k"], r["count"]) for r in rows), reverse=True):
        total += c
        if total > most:
            break
        least = 1 << k
    return least


_FOUND = ("row long, pair long, links long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "n_best long, count_sum long, groups_sha256 string")


def aligned(docs: DataFrame, a_path: str, pattern: str, b_path: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    pairs = keep(pair_documents(docs, a_path, pattern, b_path), "pairs")
    n_b, n_a = len(loaded(a_path, pattern, b_path).b.entries), len(loaded(a_path, pattern, b_path).a.entries)
    least = _threshold(pairs, common)
    often = pairs.where(F.col("n") >= least).toPandas().sort_values("pair")     # at most ``common`` rows
    a_of = F.floor(F.col("pair") / n_b).cast("long")
    highest = pairs.groupBy(a_of.alias("a")).agg(F.max("n").alias("best"))
    best = np.zeros(n_a, np.int64)
    for r in highest.collect():                                                 # at most one row for each id of A
        best[r.a] = r.best
    sent = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), best))

    def run(batches):
        units = loaded(a_path, pattern, b_path)
        units.know(*sent.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for x, texts in _groups_of_texts(batch):
                own, offs = units.fitting(*units.of(texts))
                n, shown = len(texts), units.shown
                rows, numbers, cuts = np.arange(row, row + len(texts)), own.tolist(), offs.tolist()
                digests = [hashlib.sha256(b";".join([shown[u] for u in numbers[s:e]])).hexdigest() if e > s else ""
                           for s, e in zip(cuts[:-1], cuts[1:])]
                sums = [_sums(c.all[own], offs) for c in (units.n_a, units.n_b_, units.n_groups, units.n_links,
                                                          units.n_best, units.count_sum)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(-1 - rows), pa.array(np.zeros(n, np.int64)), batch.column(0).slice(x, n),
                     *map(pa.array, sums), pa.array(digests, pa.string())], _names)
                row += n
                yield from _rare(units, own, offs, rows)

    def _rare(units: Units, own, offs, rows):
        text = np.repeat(np.arange(len(rows)), np.diff(offs))
        stay = units.rare.all[own]
        some = max(1, len(units.number))
        seen, times = np.unique(text[stay] * some + own[stay], return_counts=True)
        first, known = units.first_pair.all, units.counts[0]
        for x in range(0, len(seen), 1 << 16):
            u, t = seen[x: x + (1 << 16)] % some, seen[x: x + (1 << 16)] // some
            many = np.diff(first)[u]
            at = ragged(first[u], many)
            pair = units.pair.all[at]
            place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            out = known[place] != pair if len(known) else np.ones(len(pair), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[np.repeat(t, many)[out]]), pa.array(pair[out]),
                 pa.array((units.links.all[at] * np.repeat(times[x: x + (1 << 16)], many))[out]),
                 *[pa.nulls(int(out.sum()), pa.int64())] * 7, pa.nulls(int(out.sum()), pa.string())], _names)

    _names = [c.split()[0] for c in _FOUND.split(", ")]
    found = _texts(docs).mapInArrow(run, _FOUND)
    # rows of sums have a pair of their own below zero, so they meet nothing and spread evenly
    rare = pairs.where(F.col("n") < least).withColumn("a", a_of).join(F.broadcast(highest), "a").select(
        "pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    zero = F.lit(0).cast("long")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = found.join(rare, "pair", "left").groupBy("row").agg(
        *[F.max(c).alias(c) for c in plain],
        F.sum(F.coalesce("n_best", zero) + F.when(F.col("is_best"), F.col("links")).otherwise(zero)).alias("n_best"),
        F.sum(F.coalesce("count_sum", zero) + F.col("links") * F.coalesce("n", zero)).alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
