"""Token counts by prefix dynamic programming (operator 5).

For a byte-level BPE vocabulary, the last token of every prefix of a pre-token
is settled from left to right: among the vocabulary entries that end at byte i,
exactly one may follow the last token of the prefix before it (``can_follow``:
no merge across their border comes before the merges inside them). The count of
a prefix is one more than that of the prefix its last token follows. So one pass
over a text gives the exact count at *every* prefix, and truncation or budget
questions (``prefix_counts``, ``longest_prefix``) need no further encoding.

Pre-tokens repeat: each task keeps their counts in a cache of bounded size, and
settles the new ones of a batch together, all of one length at a time.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings
inside a text are one token each, as the tokenizer's file lists them; repeated
rows and null ids stay as they are; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import SliceTable, by_length, doc_groups, mix, text_bytes

LIMIT = 512
CACHE = 400_000
GROUP = 4 << 20             # bytes of text whose new pre-tokens are settled together
PAIRS = 1 << 20             # slots of the direct-mapped table of token pairs
LONG = 48                   # longer pre-tokens go one at a time
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


LATIN = 0x250               # texts below this code point are split by the plain re module


def _latin_pattern(pattern: str) -> re.Pattern | None:
    """The same split for texts of code points below LATIN, with its classes spelled out."""
    chars = {k: "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out = pattern.replace(r"\S", f"[^{chars[r'\s']}]").replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(chars[k] for k in (r"\s", r"\p{L}", r"\p{N}")) + "]")
    for k, own in chars.items():
        out = out.replace(k, f"[{own}]")
    return None if "\\p" in out else re.compile(out)


class PrefixCounter:
    """Exact token counts of every prefix of a text under a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} changes texts before it splits them")
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(pattern)
        self.latin = _latin_pattern(pattern)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.built = {}                         # token -> (rank of the merge that makes it, left, right)
        for i, (a, b) in enumerate(pairs):
            self.built.setdefault(a + b, (i, a, b))
        self.vocab = {as_bytes(s) for s in spec["model"]["vocab"] if s not in special}
        self.longest = max(map(len, self.vocab))
        self.tokens = sorted(self.vocab)
        self.table = SliceTable([np.frombuffer(t, np.uint8) for t in self.tokens], np.arange(len(self.tokens)))
        self.pair_code = np.full(PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(PAIRS, dtype=bool)
        self.edges: dict[tuple[bytes, int], list] = {}
        self.cache: dict[str, int] = {}

    # -------------------------------------------------------- which token may follow

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces at one end of a token (1: its right, 0: its left), from the byte up,
        each with the rank of the merge that swallows it."""
        out = self.edges.get((token, side))
        if out is None:
            out, until = [], NEVER
            while True:
                out.append((token, until))
                made = self.built.get(token)
                if made is None:
                    break
                until, token = made[0], made[1 + side]
            out.reverse()
            self.edges[out[-1][0], side] = out
        return out

    def can_follow(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of a + b is [a, b]: walk both borders in the order of merges."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            if across < x_until and across <= y_until and across < NEVER:   # of equal ranks the left pair merges first
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _may_follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``can_follow`` for arrays of token numbers, by way of a table of pairs seen."""
        code = last * len(self.tokens) + token
        at = (mix(code.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        ok = self.pair_ok[at]
        new = np.flatnonzero(self.pair_code[at] != code)
        if len(new):
            own, back = np.unique(code[new], return_inverse=True)
            n = len(self.tokens)
            found = np.fromiter((self.can_follow(self.tokens[c // n], self.tokens[c % n]) for c in own.tolist()), bool, len(own))
            ok[new] = found[back]
            slot = (mix(own.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            self.pair_code[slot[first]], self.pair_ok[slot[first]] = own[first], found[first]
        return ok

    def many_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of many pre-tokens: the same dynamic programme, for all of one length at once."""
        out = np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for size, own in by_length(lengths):
            if size > LONG:
                for k in own:
                    out[k] = self.piece_counts(pieces[k])[-1]
                continue
            for part in np.split(own, range(20000, len(own), 20000)):
                rows = np.frombuffer(b"".join([pieces[k] for k in part]), np.uint8).reshape(len(part), size)
                sums = self.table.sums(rows)
                last = np.full((size + 1, len(part)), -1, np.int64)
                count = np.zeros((size + 1, len(part)), np.int64)
                for i in range(1, size + 1):
                    for j in range(max(0, i - self.longest), i):
                        token = self.table.find(sums, j, i)
                        fits = np.flatnonzero((token >= 0) & (last[i] < 0))
                        if j and len(fits):
                            fits = fits[self._may_follow(last[j][fits], token[fits])]
                        last[i][fits] = token[fits]
                        count[i][fits] = count[j][fits] + 1
                out[part] = count[size]
        return out

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of a pre-token."""
        last, count = [b""], [0]
        vocab, longest, follow = self.vocab, self.longest, self.can_follow
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                token = piece[j:i]
                if token in vocab and (j == 0 or follow(last[j], token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"byte {piece[i - 1]} is not in the vocabulary")
        return count

    # -------------------------------------------------------- whole texts

    def _learn(self, pieces: list[str]) -> None:
        missing = set(pieces).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = set(pieces)
        missing = list(missing)
        if len(missing) < 64:
            counts = (self.piece_counts(p.encode())[-1] for p in missing)
        else:
            counts = self.many_counts([p.encode() for p in missing]).tolist()
        self.cache.update(zip(missing, counts))

    def _parts(self, text: str) -> list[tuple[str, str]]:
        """The text between special strings, each with the special string after it."""
        if self.special is None:
            return [(text, "")]
        out, at = [], 0
        for m in self.special.finditer(text):
            out.append((text[at: m.start()], m.group()))
            at = m.end()
        return [*out, (text[at:], "")]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def _split(self, text: str) -> list[str]:
        plain = self.latin is not None and not _BEYOND_LATIN.search(text)
        return (self.latin if plain else self.pattern).findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; what is not cached is settled for all of them together."""
        return [n for n, _ in self.answers(texts, None)]

    def answers(self, texts: list[str], limit: int | None) -> list[tuple[int, int]]:
        """(tokens, length of the longest prefix within the limit) of whole texts."""
        split = [[(self._split(part), special) for part, special in self._parts(t)] for t in texts]
        self._learn([p for parts in split for pieces, _ in parts for p in pieces])
        known = self.cache.__getitem__
        out = []
        for text, parts in zip(texts, split):
            own = [list(map(known, pieces)) for pieces, _ in parts]
            total = sum(map(sum, own)) + len(parts) - 1
            if limit is None or total <= limit:
                out.append((total, len(text)))
            elif len(parts) > 1:
                out.append((total, self.longest_prefix(text, limit)))
            else:
                out.append((total, self._cut(parts[0][0], own[0], limit)))
        return out

    def _part_prefixes(self, part: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings, by code points.

        A cut inside a pre-token, or after one of white space, may change how the
        last two pre-tokens are split; only those are split again there."""
        out = np.zeros(len(part) + 1, np.int64)
        spans = [m.span() for m in self.pattern.finditer(part)]
        before = 0                      # tokens up to the start of the pre-token before this one
        own = 0
        for k, (a, b) in enumerate(spans):
            piece = part[a:b]
            counts = self.piece_counts(piece.encode())
            plain = not piece[0].isspace() and piece[0] != "'"
            at = 0
            for i in range(a + 1, b + 1):
                at += len(part[i - 1].encode())
                if plain or (piece[0] == " " and i > a + 1 and not piece.isspace()):
                    out[i] = before + own + counts[at]
                else:
                    back = spans[k - 1][0] if k else 0
                    out[i] = before + sum(self.piece_counts(p.encode())[-1] for p in self.pattern.findall(part[back:i]))
            before, own = before + own, counts[-1]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:i] for every i."""
        out, done = [np.zeros(1, np.int64)], 0
        for part, special in self._parts(text):
            own = self._part_prefixes(part + special[:-1])[1:] + done
            out.append(own)
            if special:
                done += int(self._part_prefixes(part)[-1]) + 1
                out.append(np.array([done]))
        return np.concatenate(out)

    def longest_prefix(self, text: str, limit: int) -> int:
        """Length in code points of the longest prefix with at most ``limit`` tokens."""
        if self.special is not None and self.special.search(text):
            return int(np.flatnonzero(self.prefix_counts(text) <= limit)[-1])
        pieces = self._split(text)
        self._learn(pieces)
        return self._cut(pieces, list(map(self.cache.__getitem__, pieces)), limit)

    def _cut(self, pieces: list[str], counts: list[int], limit: int) -> int:
        """Length of the longest prefix within the limit: only the pre-tokens around the sum's
        crossing are looked at prefix by prefix."""
        sums = list(accumulate(counts))
        k = bisect_right(sums, limit)               # the first pre-token whose end is beyond the limit
        if k == len(sums):
            return sum(map(len, pieces))
        first = max(0, k - 1)
        while first and pieces[first - 1].isspace():        # white space may be split anew
            first -= 1
        near = self._part_prefixes("".join(pieces[first: k + 1 + pieces[k].isspace()])) + (sums[first - 1] if first else 0)
        return sum(map(len, pieces[:first])) + int(np.flatnonzero(near <= limit)[-1])


_BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN - 1)}]")
_counters: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, pattern: str) -> PrefixCounter:
    """The worker's counter for a file; its cache outlives a batch."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = PrefixCounter(path, pattern)
    return _counters[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars[, prefix_tokens]).

    ``limit_chars`` is the longest prefix (code points) within the limit;
    ``prefix_tokens`` the count at every prefix, on request."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"]

    def run(batches):
        tokens = counter(path, pattern)
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            raw, counts, cuts, every = data.tobytes(), [], [], []
            for a, b in doc_groups(data, offs, GROUP):
                texts = [raw[x:y].decode() for x, y in zip(offs[a:b], offs[a + 1: b + 1])]
                own = tokens.answers(texts, limit)
                counts += [n for n, _ in own]
                cuts += [c for _, c in own]
                if prefixes:
                    every += [tokens.prefix_counts(t) for t in texts]
            n = pa.array(counts, pa.int64())
            cols = [batch.column(0), pa.array(np.diff(offs)), n, pa.array([c > limit for c in counts], pa.bool_()),
                    pa.array(cuts, pa.int64())]
            if prefixes:
                cols.append(pa.array(every, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names + ["prefix_tokens"] * prefixes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, schema + (", prefix_tokens array<long>" if prefixes else ""))
