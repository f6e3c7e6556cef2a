import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hirelens.llm import chat, counts, pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "é", "日", "1", "23", "!", "...", "<|endoftext|>", "\t", " ", "the", "ing",
            " of", "Z", "²", "\r\n", "😀", "▁", "th", "e", "tion", "x"]


def sample(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


# ------------------------------------------------------------ token counts

@pytest.fixture(scope="module")
def counter():
    return counts.PrefixCounter(BPE, public_tokenizers.PATTERN)


def test_every_prefix_and_budget(counter):
    library = Tokenizer.from_file(BPE)
    for text in sample(1, 150, 12):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want and counter.count(text) == want[-1]
        for limit in (0, 1, 3, 8):
            assert counter.longest_prefix(text, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_counts_of_documents(spark, counter):
    from conftest import SF_SMALL
    library = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in counts.token_counts(docs, BPE, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        mine = got[r.doc_id]
        assert (mine.n_bytes, mine.n_tokens, mine.over_limit) == (len(r.text.encode()), n, n > 512)
        assert len(library.encode(r.text[: mine.limit_chars], add_special_tokens=False).ids) <= 512


def test_count_edges(spark, counter):
    long_word, many = "ab" * 30000, "x y " * 40000
    rows = [(1, None, 5), (1, "", 5), (None, "<|endoftext|>a", 5), (2, long_word, 5), (2, many, 5), (2, many, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(BPE)
    want = sorted(str((d, len(library.encode(t or "", add_special_tokens=False).ids))) for d, t, _ in rows)
    own = counts.token_counts(docs, BPE, public_tokenizers.PATTERN)
    assert sorted(str((r.doc_id, r.n_tokens)) for r in own.collect()) == want
    assert counts.token_counts(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)


# ------------------------------------------------------------ N-best segmentation

@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(MODEL)


def every_segmentation(model, text):
    s = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
        for j in range(i + 1, min(len(s), i + model.longest) + 1):
            k = model.id.get(s[i:j])
            if k is not None:
                go(j, score + float(model.score[k]), ids + (k,))
            elif j == i + 1:
                go(j, score + model.unknown_score, ids + model._fallback(s[i]))

    go(0, 0.0, ())
    return sorted((x[0] for x in out), reverse=True)


def test_n_best_against_all_segmentations(model):
    for text in (t[:11] for t in sample(2, 150, 5)):
        want = every_segmentation(model, text)
        for n in (1, 3):
            got = model.text_n_best(text, n)
            assert [x[0] for x in got] == pytest.approx(want[:n])
            assert len({tuple(ids) for _, ids in got}) == len(got)
            assert all(model.decode(ids) == text.replace(pieces.SPACE, " ") for _, ids in got)
            assert model.encode([text], n)[3][0] == pytest.approx(want[:n])


def test_batch_and_single_search_agree(model):
    long_segment = "thing" * 40
    for s in ["▁" + w for w in ("the", "thething", "éxyz日本", long_segment)]:
        by_search = model.n_best(s, 2)
        model.clear()
        model.learn([s] * 2 + ["▁filler"])
        k = model.cache[s]
        assert model.best[k] == pytest.approx(by_search[0][0])
        assert model.gap[k] == pytest.approx(by_search[0][0] - by_search[1][0])


def test_encode_and_decode_tables(spark):
    from conftest import SF_SMALL
    rows = [(1, None, 1), (1, "", 1), (None, "a\x00b　 c", 1), (3, "x" * 50000, 1), (4, " lead  and trail ", 1), (4, " lead  and trail ", 1)]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(r[0] and r[0] + 10_000, r[1]) for r in rows], "doc_id long, text string"))
    coded = pieces.encode(docs, MODEL).cache()
    assert coded.where("NOT round_trip").count() == 0
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, MODEL).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert all(len(r.ids) == r.n_pieces and abs(r.n_best_scores[0] - r.score) < 1e-6
               and r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in coded.collect())
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_n_best_segmentations_and_decoded_text(spark, model):
    texts = [None, "", "a\n b", "the thing", " lead  and", *sample(5, 30, 5)]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).withColumn(
        "all_ids", pieces.n_best_ids()).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        want = model.text_n_best(text, pieces.N_BEST)
        assert r.all_ids == [ids for _, ids in want] and r.all_ids[0] == r.ids
        assert r.n_best_scores == pytest.approx([s for s, _ in want])
        assert r.decoded == text.replace(pieces.SPACE, " ") and r.round_trip == (r.decoded == text)
    assert len(rows) == len(texts) and any(len(r.all_ids) == pieces.N_BEST for r in rows)


# ------------------------------------------------------------ chat

CONTROL = ["</s>", "<s>", "[INST] ", "[/INST]", "\\", "[", "<", "/s>", "INST]", "[ROLE x] ", "[/ROLE]", "a", " ", "\n", "[OUT", "]", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\"]),
                          st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    text = "<s>" + "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse(text) == turns
    for r, t in turns:
        shown, a, b = chat.render(r, t)
        assert chat.unescape(shown[a:b]) == t and not any(c in chat.escape(t) for c in ("</s>", "<s>", "[/INST]", "[INST] "))


def talk_rows():
    rng = random.Random(9)
    rows = []
    for c in range(12):
        n = rng.choice([1, 2, 5, 9, 120])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "word " * rng.choice([0, 1, 5, 40, 200, 700]) + rng.choice(CONTROL)))
    rows += [(20, 0, "system", "only")] + [(21, 5, None, None), (21, None, "tool", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    rows += [(22, 0, "assistant", "same")] * 3
    return rows


def test_windows_and_digests(spark):
    rows = talk_rows()
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.windows(talks, BPE, public_tokenizers.PATTERN).cache()
    wins = formatted.collect()
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for _, x, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in wins if w.conv_id == c)
    for w in wins:
        turns = chat.parse(w.text)
        new = len(turns) - w.n_repeated
        assert new >= 1 and (w.tokens <= chat.BUDGET or new == 1 or w.over_budget)
        own = sorted(groups[w.conv_id], key=lambda x: x[0])
        if w.first and own[0][1] == "system":
            assert turns[0] == own[0][1:] and w.n_repeated >= 1
        assert len(w.loss) == sum(r == "assistant" for r, _ in turns[w.n_repeated:])
    assert any(w.n_repeated for w in wins)
    assert not any(w.over_budget and len(chat.parse(w.text)) - w.n_repeated > 1 for w in wins)
    empty = chat.windows(talks.limit(0), BPE, public_tokenizers.PATTERN)
    assert chat.digests(empty).count() == 0


def test_windows_keep_the_budget(spark):
    """Only a turn that is too long by itself, with the system turn, makes a window exceed it."""
    rng = random.Random(6)
    rows = []
    for c, system in enumerate((0, 10, 250, 300, 806, 1500, 1900, 2030, 2500)):
        if system:
            rows.append((c, 0, "system", "word " * system))
        for t in range(1, 60):
            n = rng.choice([1, 20, 100, 100, 100, 126, 130, 500, 515, 700]) if c % 2 else 100
            rows.append((c, t, rng.choice(["user", "assistant"]), "word " * n))
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    size = {}
    for r in chat.placed_turns(talks, BPE, public_tokenizers.PATTERN).collect():
        size[r.conv_id, r.ord] = r.tokens, r.role
    seen = 0
    for w in chat.windows(talks, BPE, public_tokenizers.PATTERN).collect():
        system = size[w.conv_id, 0][0] if size[w.conv_id, 0][1] == "system" else 0
        new = len(chat.parse(w.text)) - w.n_repeated
        own = [size[w.conv_id, w.first + k][0] for k in range(new)]
        assert w.tokens <= chat.BUDGET or (new == 1 and own[0] + (system if w.first else 0) > chat.BUDGET) or (
            w.first == 0 and own[0] > chat.BUDGET), (w.conv_id, w.first, w.tokens, own, system)
        seen += new
    assert seen == len(rows)
