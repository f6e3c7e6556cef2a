import hashlib
import random
import re
import zlib

from hirelens.llm import queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    """Every maximal stretch of every period, its smallest period kept."""
    best = {}
    n = len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, ln, q) for (s, ln), q in best.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def collapsed(w, found):
    gone = {i for s, ln, q in found for i in range(s + q, s + ln)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 4000, "a b " * 6, "x " + "a b " * 6 + "y", "a b c " * 4 + "a b",
           "A\x85b\xa0c " * 9, "abcdef " * 5 + "g " + "abcdef " * 12, "日本 é " * 8]
    for letters in (1, 2, 2, 2, 3, 3, 4, 8):
        for n in (12, 13, 40, 200, 400):
            out.append(" ".join(rng.choice("abcdefgh"[:letters]) for _ in range(n)))
    for _ in range(60):                                     # runs inside runs, at every exponent
        w = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 3)):
            w = w * rng.randint(1, 4) + [rng.choice("abc") for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n"]).join(w[:3000]))
    f = ["a", "b"]                                          # Fibonacci words have the most runs
    while len(f[-1]) < 1500:
        f.append(f[-1] + f[-2])
    return out + [" ".join(f[-1]), " ".join("k%d" % rng.randrange(40) for _ in range(3000)) + " t u v w x y z" * 300]


def test_runs_against_every_period(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.period))
    for i, t in rows:
        assert sorted(got.get(i, [])) == brute_runs(WORDS.findall(t or "")), i
    text = {r.doc_id: r.collapsed_text for r in runs.collapse_runs(df).collect()}
    for i, t in rows:
        w = WORDS.findall(t or "")
        assert text[i] == collapsed(w, brute_runs(w))
    short = {}
    for r in runs.periodic_runs(df, least=4).where("doc_id between 20 and 60").collect():
        short.setdefault(r.doc_id, []).append((r.start, r.length, r.period))
    for i, t in rows[20:61]:
        assert sorted(short.get(i, [])) == brute_runs(WORDS.findall(t or ""), 4)


def test_op12_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    rows += [(1000 + i, " ".join(rng.choice(["the", "a", "of", "x%d" % rng.randrange(30)]) for _ in range(rng.randint(1, 300))), "de")
             for i in range(150)]
    rows += [rows[6], rows[6], (None, "a " * 30, "en"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id int, text string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        w = planted(i, WORDS.findall(t or ""))
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join("%d,%d,%d\n" % r for r in found)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 60


def test_runs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_runs int")
    assert runs.run_digests(df).collect() == [] and runs.periodic_runs(df).collect() == []
