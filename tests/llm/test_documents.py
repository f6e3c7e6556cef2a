import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from test_pii import base

import corpus_pipeline
from hirelens.llm import decontaminate, lines, mixing, pieces, quality, simhash
from hirelens.llm.pii import KINDS
from hirelens.llm.queries import PIECES, tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one", "a b c a b c a b c", "x\ny\nx\n\n y\nx ", "é ü\n#$%|<>&*\nA\x85b c", "same line of five words\n" * 3,
         "w " * 60, "|#" * 5000, " ".join(str(i) for i in range(3000))]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


# ------------------------------------------------------------ quality rules

def test_base_rules_against_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "a b\n", "\x0b", " "]) for _ in range(rng.randint(0, 150)))
                     for _ in range(150)]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "h", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string, n_words int").repartition(3)
    got = {r.doc_id: r for r in lines.verdicts(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
        repeat = {p for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for p in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_frequent_lines_deplete_documents(spark):
    body = " ".join(f"u{i}" for i in range(60))
    rows = []
    for i in range(60):         # half of the words stand in a line that the whole host shares
        own = " ".join(f"d{i}w{k}" for k in range(40))
        rows.append((i, f"Shared 1 Banner line {body}\n{own}" if i < 40 else own + " " + body, "a"))
    rows += [(100 + i, f"shared 2  banner LINE {body}", "b") for i in range(5)] + [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lines.verdicts(docs, min_docs=20).collect()}
    assert not any(got[i].kept for i in range(40)) and got[0].n_line_words_removed == 64
    assert all(got[i].kept for i in range(40, 60))
    assert all(got[100 + i].kept and got[100 + i].n_line_words_removed == 0 for i in range(5))
    cut = {r.doc_id: r.text for r in lines.cleaned(docs, min_docs=20).collect()}
    assert cut[3] == " ".join(f"d3w{k}" for k in range(40)) and cut[101] == rows[61][1]
    assert lines.verdicts(docs.limit(0)).count() == 0


def line_verdicts(rows, least_words):
    """(words removed, kept) of each row, from the production limits."""
    def norm(line):
        return " ".join(WORDS.findall(re.sub("[0-9]", "0", line.lower())))

    held = defaultdict(set)
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            held[s, norm(line)].add((d, t))
    out = {}
    for d, t, s in rows:
        w = WORDS.findall(t or "")
        grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
        repeat = {p for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for p in (k, k + 1, k + 2)}
        own = [(norm(line), len(WORDS.findall(line))) for line in (t or "").split("\n")]
        gone = sum(n for line, n in own if n >= least_words and len(held[s, line]) > 20)
        out[d, s] = gone, len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and 2 * (len(w) - gone) >= len(w)
    return out


def test_the_limit_does_not_grow_with_the_host(spark):
    banner = " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = []
    for i in range(1200):       # one line in 22 documents of 1,200, one in exactly the limit
        own = " ".join(f"w{k}x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for k in range(55))
        rows.append((i, f"{banner}\n{own}" if i < 22 else f"{own}\nheld by twenty {banner}" if i < 42 else own, "large"))
    rows += [(2000 + i, f"{banner}\nw{i}", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source): (r.n_line_words_removed, r.kept) for r in lines.verdicts(docs).collect()}
    assert got == line_verdicts(rows, lines.MIN_LINE_WORDS) and sum(not kept for _, kept in got.values()) == 22


def test_short_lines_are_counted_and_removed(spark):
    menu = [f"{a} {b}" for a in ("Read", "Log", "Sign", "Go") for b in ("more", "in", "out", "up", "on", "by", "to", "off")]
    rows = [(i, "\n".join(menu), "a") for i in range(21)]                          # nothing but shared lines: 64 words
    rows += [(100 + i, "Read MORE\n" + " ".join(f"w{k}x{chr(97 + i)}" for k in range(60)) + "\n\nOk", "a") for i in range(20)]
    rows += [(200 + i, "\n".join(menu), "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source): (r.n_line_words_removed, r.kept) for r in lines.verdicts(docs).collect()}
    assert got == line_verdicts(rows, 1)
    assert all(got[i, "a"] == (64, False) for i in range(21)) and all(got[100 + i, "a"] == (2, True) for i in range(20))
    assert all(got[200 + i, "b"] == (0, True) for i in range(20))
    cut = {r.doc_id: r.text for r in lines.cleaned(docs).collect()}
    assert cut[0] == "" and cut[100].startswith("w0xa ") and cut[100].endswith("\n\nOk") and cut[200] == rows[41][1]


# ------------------------------------------------------------ quality classifier

def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    scored = {r.doc_id: r.s for r in quality.with_score(docs.select("doc_id", "text"), model, "s").collect()}
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if fold(r.doc_id) == 0]
    good = [s for s, y in held if y == 1]
    bad = [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.97 and np.mean([s < quality.THRESHOLD for s in bad]) > 0.8


def test_classifier_edges(spark):
    rows = [(i, t, "s", 0.5) for i, t in enumerate(TEXTS)] + [(None, "x", "s", 0.1), (3, "one", "s", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, score double")
    none = spark.createDataFrame([(None, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    out = quality.with_score(docs, model, "__score")
    assert out.columns == [*docs.columns, "__score"]
    assert {r["__score"] for r in out.collect()} == {0.5} and out.count() == len(rows)
    assert quality.keep_good(docs, none).columns == docs.columns
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 < r["__score"] < 1 for r in quality.with_score(docs, quality.train(docs, one), "__score").collect())
    assert quality.with_score(docs.limit(0), model).count() == 0


# ------------------------------------------------------------ decontamination

def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != c))
    return min(row)


def test_contamination_against_brute_force(spark):
    rng = random.Random(6)
    words = ["the", "of", "an", "erin", "thand", "é", "nd,", "Tion.", "st"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 25)))) for k in range(12)]
    items += [(50, None), (51, "the of"), (None, items[0][1]), (3, items[3][1])]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if d % 2:
            own = list(items[d % 12][1])
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "the", own[0]])
            text[len(text) // 2: len(text) // 2] = ["".join(own)]
        docs.append((d, rng.choice([" ", "\n", " - "]).join(text)))
    docs += [(99, None), (99, ""), (None, items[1][1].upper()), (1, docs[1][1])]
    table = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, distance string")
    want = []
    for d, t in docs:
        text = decontaminate.normalise((t or "").encode())
        for k, p in items:
            pattern = decontaminate.normalise((p or "").encode())
            if len(pattern) >= decontaminate.MIN_BYTES:
                far = edit_distance_in(pattern, text)
                if far <= int(decontaminate.ERROR_RATE * len(pattern)):
                    want.append(str((d, k, far)))
            elif pattern and b" " + pattern + b" " in b" " + text + b" ":     # short items: exact, between word borders
                want.append(str((d, k, 0)))
    got = [str(tuple(r)) for r in decontaminate.contaminated(table, benchmark).collect()]
    assert sorted(got) == sorted(want) and any(x[-2] != "0" for x in want)
    kept = decontaminate.clean(table, benchmark)
    assert kept.columns == table.columns
    hit = {x.split(",")[0] for x in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if f"({d}" not in hit)
    assert decontaminate.contaminated(table, benchmark.limit(0)).count() == 0 == decontaminate.contaminated(table.limit(0), benchmark).count()


def test_short_items_are_searched(spark):
    docs = spark.createDataFrame([(1, "Q: what is 12\nplus 30?"), (2, "somewhat is 12 plus 30"), (3, "what is 12 plus 301"),
                                  (4, "What is 12 + 30"), (5, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is 12 plus 30"), (8, "..."), (9, "X")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert got == [(1, 7, 0), (5, 9, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3, 4]


def test_blocks_of_a_large_benchmark_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert whole and sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == whole


# ------------------------------------------------------------ language model

@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (None, "The The"), (9003, docs.head().text), (9004, "ab " * 70000)],
                                  "doc_id long, text string")
    both = docs.unionByName(extra).withColumn("score", mixing.F.lit(1))
    return both.collect(), {r.doc_id: r for r in mixing.score(both).collect()}


def test_base_score_against_brute_force(scored):
    rows, got = scored
    assert len(got) == len(rows)

    def tokens(t):
        return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]

    counts = Counter()
    for r in rows:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own, mine = tokens(r.text), got[r.doc_id]
        base = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert (mine.n_tokens, mine.n_known, mine.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert mine.base_score == pytest.approx(base) and mine.score < 0
        assert mine.held_out == (r.doc_id is not None and fold(r.doc_id) == 1)


def test_mixing_beats_single_orders_and_is_a_probability():
    """Of all texts of one byte more, the model's probabilities add up to one."""
    texts = ["the cat sat on the mat. the dog sat. " * 30, "a thing of the thing"] * 20
    code_of = np.zeros(256, np.int64)
    parts = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        text, at, _, _ = mixing.normalised(raw, np.array([0, len(raw)]))
        code_of += np.bincount(text, minlength=256)
        parts.append((text, at))
    code = mixing.Code.of(code_of)
    counts, model = mixing.Counts(code), mixing.Mixer.new()
    for p in parts[:30]:
        counts.add(*p)
    counts.flush()
    tables = [mixing.log_odds(c[0::2], c[1::2]) for c in counts.cells]
    for p in parts[30:]:
        model.learn(tables, mixing.Decisions(*p, code))
    fix = model.refined()
    stem = np.frombuffer(b"the ca", np.uint8)
    total = 0.0
    for b in range(256):
        text = np.append(stem, np.uint8(b))
        d = mixing.Decisions(text, np.array([0, len(text)]), code, skip=len(stem))
        total += np.exp(model.cost(tables, fix, d).sum())
    assert total == pytest.approx(1, abs=1e-3)
    d = mixing.Decisions(*parts[35], code)
    assert -model.cost(tables, fix, d).sum() / np.log(2) / len(parts[35][0]) < 1.0


def test_long_text_in_parts_costs_the_same():
    rng = np.random.default_rng(3)
    raw = rng.choice(np.frombuffer(b"abc de", np.uint8), 300_000)
    raw[70_000:170_000] = ord("x")                          # a word longer than a part
    raw[180_000:185_000] = rng.choice(np.frombuffer(b"yz", np.uint8), 5_000)
    text, at, _, _ = mixing.normalised(raw, np.array([0, len(raw)]))
    code = mixing.Code.of(np.bincount(text, minlength=256))
    whole = mixing.Decisions(text, at, code)
    parts = [mixing.Decisions(*p[:2], code, *p[2:]) for p in mixing.parts_of(text, at)]
    assert len(parts) > 2
    for i in range(len(mixing.ORDERS)):
        assert (np.concatenate([p.slots[i] for p in parts]) == whole.slots[i]).all()


def test_costs_of_bytes_are_those_of_their_decisions(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["the", "a", "café", "x" * 70, "of", "12"] + ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words, 50)) for _ in range(60)] + ["", "the"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    text, at, _, _ = mixing.normalised(raw, offs)
    code = mixing.Code.of(np.bincount(text, minlength=256))
    counts, model = mixing.Counts(code), mixing.Mixer.new()
    counts.add(text, at)
    counts.flush()
    tables = [mixing.log_odds(c[0::2], c[1::2]) for c in counts.cells]
    d = mixing.Decisions(text, at, code)
    model.learn(tables, d)
    fix = model.refined()
    want = np.add.reduceat(model.cost(tables, fix, d), np.cumsum(code.size[text]) - code.size[text])
    for bits in (20, 6):                                    # also where bytes push each other out
        monkeypatch.setattr(mixing, "MEMO", bits)
        costs = mixing.Costs(code, tables, model, fix)
        for _ in range(2):
            assert (costs.of(text, at) == want).all()


def test_counts_beyond_32_bits(spark):
    cells = np.zeros(mixing.BLOCK, np.int64)
    cells[:8] = 2_000_000_000, 1_900_000_000, 3, 0, 0, 2_147_483_647, 0, 0
    rows = [(o, 0, mixing._pack(cells * (o >= 0) + 7 * (o < 0)), 0.0, 0.0) for o in (0, 0, 3, -1)]
    total = mixing.add_blocks(spark.createDataFrame(rows, mixing._ROWS))
    sums = {r.o: mixing._unblock(bytes(r.cells)) for r in total.collect()}
    assert sums[0][:8].tolist() == [4_000_000_000, 3_800_000_000, 6, 0, 0, 4_294_967_294, 0, 0]
    assert (sums[3] == cells).all() and (sums[-1] == 7).all()
    tables = mixing.tables_of(total)
    for t, times in ((tables[0], 2), (tables[3], 1)):
        level, odds = t & (mixing.LEVELS - 1), t >> 3
        assert level[:4].tolist() == [7, 3 if times == 2 else 2, 7, 0]
        assert odds[0] == round(np.log(1.9 / 2) * mixing.SCALE) and odds[1] < 0 < odds[2] == 127
    small = mixing.log_odds(cells[0::2].astype(np.int32), cells[1::2].astype(np.int32))
    assert (small == tables[3][: len(small)]).all()


def test_a_task_gives_out_full_cells(spark, monkeypatch):
    text = np.frombuffer(b"the cat sat on the mat. the dog sat.\n" * 400, np.uint8)
    code = mixing.Code.of(np.bincount(text, minlength=256))
    monkeypatch.setattr(mixing, "MOST", 20_000)
    parts, got, rounds = mixing.Counts(code), defaultdict(int), 0
    for a in range(0, len(text), 37):       # a line is a text of its own
        parts.add(text[a: a + 37], np.array([0, 37]))
        parts.flush()
        if parts.full() or a + 37 == len(text):
            rounds += 1
            for o, k, c in parts.blocks():
                got[o, k] = got[o, k] + mixing._unblock(c)
    whole = mixing.Counts(code)
    whole.add(text, np.arange(0, len(text) + 1, 37))
    want = {(o, k): mixing._unblock(c) for o, k, c in whole.blocks()}
    assert not whole.held and not any(c.any() for c in whole.cells)
    assert rounds > 2 and set(got) == set(want) and all((got[x] == want[x]).all() for x in want)


# ------------------------------------------------------------ pipeline

def test_pipeline_against_its_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    good = {r.doc_id for r in quality.with_score(docs, model).collect() if r.score >= quality.THRESHOLD}
    fps = {r.doc_id: simhash.simhash(r.text.encode()) for r in docs.collect() if r.doc_id in good}
    classes = defaultdict(set)
    for d in sorted(fps):
        near = {min(c) for c in classes.values() for x in c if bin(fps[x] ^ fps[d]).count("1") <= 2}
        joined = {d}.union(*(classes.pop(k) for k in near)) if near else {d}
        classes[min(joined)] = joined
    hit = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = set(classes) - hit
    assert set(out) == want and all(r.round_trip for r in out.values())
    # the last stage's ids are the whole texts with personal data replaced, found here by plain regexes
    coded = spark.createDataFrame([(r.doc_id, r.ids) for r in out.values()], "doc_id long, ids array<int>")
    shown = {r.doc_id: r.text for r in pieces.decode(coded, tokenizer(PIECES)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    replaced = 0
    for d in want:
        text, at = "", 0
        found = sorted((a, -b, KINDS.index(kind), kind) for kind, a, b in base(texts[d]))
        while found:
            a, b, _, kind = found.pop(0)
            end = -b
            while found and found[0][0] < end:                  # overlapping spans become one, named after the first
                end = max(end, -found.pop(0)[1])
            text, at = text + texts[d][at:a] + f"<{kind.upper()}>", end
            replaced += 1
        assert shown[d] == text + texts[d][at:], d
    assert replaced > 5
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][0]] == [5, "quality"]


def naive_boosting(x, y, depth, rounds):
    """Newton boosting with every split tried on its own rows: predicted log odds of the rows."""
    base = np.log((y.sum() + 1) / (len(y) + 2) / (1 - (y.sum() + 1) / (len(y) + 2)))
    z = np.full(len(y), base)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]))) for j in range(x.shape[1])]

    def grow(rows, g, h, level):
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + quality.L2)
        for j in range(x.shape[1]) if level else ():
            top = (-np.inf, None)
            for e in edges[j]:
                left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                if h[left].sum() >= 1e-3 and h[right].sum() >= 1e-3:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.L2) for s in (left, right)) - whole
                    if gain > top[0] + 1e-12:
                        top = gain, e
            if top[1] is not None and top[0] > best[0] + 1e-12:
                best = top[0], j, top[1]
        if not level:
            step[rows] = -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
        elif best[1] is None:
            grow(rows, g, h, level - 1)
        else:
            grow(rows[x[rows, best[1]] <= best[2]], g, h, level - 1)
            grow(rows[x[rows, best[1]] > best[2]], g, h, level - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        z = z + step
    return z


def test_trees_against_every_split():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = np.column_stack([rng.normal(size=80), rng.integers(0, 4, 80), rng.random(80) ** 3, np.zeros(80)])
        y = ((x[:, 0] + (x[:, 1] == 2) + rng.normal(size=80) * 0.7) > 0.4).astype(float)
        got = quality.fit(x, y, 3, 5).score(x)
        assert got == pytest.approx(1 / (1 + np.exp(-naive_boosting(x, y, 3, 5))), abs=1e-9)
