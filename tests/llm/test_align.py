import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hirelens.llm import align, queries
from hirelens.llm.queries import BYTE_BPE, PIECES, _split_pattern, tokenizer

PATHS = (tokenizer(BYTE_BPE), _split_pattern(), tokenizer(PIECES))


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "  two  spaces ", "the", "special <|endoftext|> and <s> </s> <unk> <0x41>", "piece ▁ mark", "a\x00b", "tab\tline\r\n\n x",
           "naïve café 日本語テキスト 😀🏳️‍🌈 é  ​ ", "aaaa" * 3000, "漢字" * 700, "=" * 999, "x" * 64 + " " * 64, "﻿bom", "١٢٣ ½ ﬁ"]
    words = ["Internationalisation", "the", "of", "tokenizers", "ŝanĝo", "données", "12,345.67", "(ok)", "re-use", "日本", "\n", "http://a.b/c?d=e"]
    while len(out) < 150:
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", "  "]) for _ in range(rng.randint(1, 80))))
    for _ in range(60):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x800), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randint(1, 60))))
    return out + [out[40], out[40]]


def brute(all_texts):
    """Contract by plain loops, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    letters = align._byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(False).items() if all(c in letters for c in t)}
    docs = []
    for t in all_texts:
        raw = b" " + (t or "").encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs = [a_bytes[i] for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(xs) != raw or b"".join(ys) != raw:
            docs.append([])
            continue
        groups, i, j = [], 0, 0
        ends = set(np.cumsum([len(v) for v in xs]).tolist()) & set(np.cumsum([len(v) for v in ys]).tolist())
        at_a = at_b = 0
        for end in sorted(ends):
            ga, gb = [], []
            while at_a < end:
                ga.append(x[i]); at_a += len(xs[i]); i += 1
            while at_b < end:
                gb.append(y[j]); at_b += len(ys[j]); j += 1
            groups.append((ga, gb))
        docs.append(groups)
    count = Counter()
    for g in docs:
        count.update({(x, y) for ga, gb in g for x in ga for y in gb})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g in docs:
        links = [(x, y) for ga, gb in g for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return docs, out


@pytest.mark.parametrize("common", [align.COMMON, 0, 40])
def test_alignment_against_plain_loops(spark, tmp_path, common):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts())] + [(None, "the tokenizers", "y", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, a string, n_a int").repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, want = brute([t for _, t, *_ in rows])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = queries.op13_alignment(spark, str(tmp_path)) if common == align.COMMON else align.aligned(df, *PATHS, common=common)
    got = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    assert got == sorted(((i, *w) for (i, *_), w in zip(rows, want)), key=str)
    assert sum(not w[0] for w in want) < 40 and max(w[3] / max(w[2], 1) for w in want) > 2
    if common == align.COMMON:
        lists = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in align.groups(df.where("doc_id IS NOT NULL"), *PATHS).collect()}
        assert lists == {i: [(list(x), list(y)) for x, y in g] for (i, *_), g in zip(rows, docs) if i is not None}


def test_cuts_of_random_token_lengths():
    rng = random.Random(8)
    for near in (1, 2, 6):
        a_end, b_end, a_offs, b_offs, want, base = [], [], [0], [0], [], 0
        for _ in range(200):
            n = rng.choice([0, 1, 2, 5, 40, 300])
            cuts = []
            for most in rng.sample([1, 3, 9, 60], 2):
                at, ends = 0, []
                while at < n:
                    at = min(n, at + rng.randint(1, most))
                    ends.append(base + at)
                cuts.append(ends)
            shared, i, j = sorted(set(cuts[0]) & set(cuts[1])), len(a_end), len(b_end)
            for end in shared:
                x = i + sum(1 for e in cuts[0] if (want[-1][4] if want else 0) < e <= end)
                y = j + sum(1 for e in cuts[1] if (want[-1][4] if want else 0) < e <= end)
                want.append((i, x, j, y, end))
                i, j = x, y
            a_end += cuts[0]
            b_end += cuts[1]
            a_offs.append(len(a_end))
            b_offs.append(len(b_end))
            base += n
        got = align.shared_groups(np.array(a_end), np.array(b_end), np.array(a_offs), np.array(b_offs), near)
        assert got.T.tolist() == [list(w[:4]) for w in want]


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(df, *PATHS).collect() == [] and align.groups(df, *PATHS).collect() == []
