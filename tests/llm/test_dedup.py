import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from hirelens.llm import simhash, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=120):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "日本", "X.", "the"]
    passages = [" ".join(rng.choice(vocab) for _ in range(k)) for k in (34, 35, 36, 60, 90)]
    out = [None, "", "  \n", "one", "one two", "Der " * 100, "a b " * 60, " ".join(passages), "A\x85b\xa0c d"]
    while len(out) < n:
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 130)))
        if rng.random() < 0.5:
            p = rng.choice(passages).split()
            a = rng.randint(0, 5)
            t += rng.choice([" ", "\n"]) + " ".join(p[a:]) + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))
        out.append(t)
    for k in range(30, 40):
        near = out[k].split()
        near[rng.randrange(len(near))] = "changed"
        out += [out[k], " ".join(near)]
    return out


def removed(all_words, length):
    seen = Counter(tuple(w[i: i + length]) for w in all_words for i in range(len(w) - length + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i: i + length])] > 1:
                gone.update(range(i, i + length))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_substring_dedup_against_brute_force(spark):
    own = texts(1)
    rows = [(i, t, "x", 1) for i, t in enumerate(own)] + [(7, own[7], "x", 1), (None, own[12], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long").repartition(5)
    for length, seed in ((35, 6), (9, 3)):
        words = [WORDS.findall(t or "") for _, t, *_ in rows]
        kept = removed(words, length)
        want = sorted(str((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()))
                      for (d, *_), w, k in zip(rows, words, kept))
        got = sorted(str(tuple(r)) for r in substring.substring_digest(docs, length, seed).collect())
        assert got == want
    shown = {r.doc_id: r.kept_text for r in substring.substring_dedup(docs.where("doc_id < 40")).collect()}
    assert shown[3] == "one" and shown[0] == ""
    assert substring.substring_digest(docs.limit(0)).count() == 0


def fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = WORDS.findall(t)
    hs = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def classes(ids, fps, most):
    n, label = len(fps), list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[j] < label[i] and bin(fps[i] ^ fps[j]).count("1") <= most:
                    label[i], changed = label[j], True
    best = {}
    for d, k in zip(ids, label):
        if d is not None:
            best[k] = min(best.get(k, d), d)
    return [best.get(k) for k in label]


def test_simhash_against_brute_force(spark):
    own = texts(2, 80)
    rows = [(100 + i, t, "x") for i, t in enumerate(own)] + [(100, own[0], "y"), (None, own[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    for most in (2, 12):
        fps = [fingerprint(t) for _, t, _ in rows]
        want = sorted(str((d, "%016x" % f, c)) for (d, _, _), f, c in zip(rows, fps, classes([r[0] for r in rows], fps, most)))
        got = sorted(str((r.doc_id, "%016x" % (r.fp % (1 << 64)), r.component_id)) for r in simhash.near_duplicates(docs, 3, most).collect())
        assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    want = {c for c in classes([r[0] for r in rows], [fingerprint(t) for _, t, _ in rows], 2) if c is not None}
    assert {r.doc_id for r in kept.collect()} - {None} == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives_lose_no_text_and_keep_one_row_each(spark):
    rows = [(1, "a b c d e", 0), (3, "q w e r t y", 1), (3, "a b c d e", 2), (None, "a b c d e", 3), (None, "lone row of no id", 4),
            (9, "twice the same row", 5), (9, "twice the same row", 6), (None, "no id twice here", 7), (None, "no id twice here", 8),
            (4, None, 9), (5, "", 10)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"]
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    want = [(1, "a b c d e"), (3, "q w e r t y"), (None, "lone row of no id"), (9, "twice the same row"),
            (None, "no id twice here"), (4, None)]
    assert got == sorted(map(str, want))


def test_tree_shards_and_forest_lose_no_link():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(b)) for c in centres for b in rng.integers(0, 63, 12)]
    dense = [centres[0] ^ np.uint64(int(a) | int(b) << 1) for a in range(16) for b in range(16)]
    points = np.unique(np.concatenate([centres, np.array(near), np.array(dense), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))
    links = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2) if i < j}
    tree = simhash.build_tree(points[::3], 5)
    idx, shard = simhash.assign(points, tree, 2)
    members = {}
    for i, s in zip(idx.tolist(), shard.tolist()):
        members.setdefault(s, set()).add(i)
    assert len(members) > 8
    assert all(any({i, int(j)} <= m for m in members.values()) for i, j in links)
    old = simhash.LOCAL_LEAF
    try:
        simhash.LOCAL_LEAF = 64
        a, b = simhash.forest(points, 2)
    finally:
        simhash.LOCAL_LEAF = old
    lab = simhash._roots(len(points), np.searchsorted(points, a), np.searchsorted(points, b), np.arange(len(points)))
    want = simhash._roots(len(points), *map(np.array, zip(*links)), np.arange(len(points)))
    assert (lab == want).all()
    assert (np.bitwise_count(a ^ b) <= 64).all()


def test_dense_points_are_linked_by_their_neighbours(monkeypatch):
    """Fingerprints within four bits of one centre, which no vantage point parts."""
    rng = np.random.default_rng(5)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5000, 4), dtype=np.uint64), axis=1)
    points = np.unique(np.uint64(0x123456789ABCDEF0) ^ flips)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = simhash._roots(len(points), i, j, np.arange(len(points)))
    for slice_ in (1 << 23, 1 << 14):
        monkeypatch.setattr(simhash, "NEIGHBOURS", slice_)
        assert (simhash._neighbour_labels(points) == want).all()
        a, b = simhash.forest(points, 2)
        lab = simhash._roots(len(points), np.searchsorted(points, a), np.searchsorted(points, b), np.arange(len(points)))
        assert (lab == want).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
