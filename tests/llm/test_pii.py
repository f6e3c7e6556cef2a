import hashlib
import random
import re

from hirelens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    """Leftmost non-overlapping matches per kind; failing ones are dropped."""
    text = text or ""
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True,
                    "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


HAND = [
    None, "", " ", "a@b.c_d@e.f", "x..y@z.q.r.", "me@host", "é.ü@mail.com and a@b-c.d-e", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.000.1.2",
    "4111 1111 1111 1111", "4111-1111 1111-1111x", "4111  1111 1111 1111", "card 4111111111111112", "41111111111111111111",
    "+1 (683) 555-0123.", "+12", "+1234567", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "😀 +49 30 901820 😀 a@b.co",
    "john [at] mail [dot] com", "fe80:0:0:0:1:2:3:4", "9" * 3000, "1 " * 9000, "a." * 20000, "+1" + " " * 5000,
    "4111 1111 1111 1111 a@b.co 10.0.0.1 +1 683 555 0123"]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string, score string")


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    tokens = ["a", "B", "@", ".", "-", " ", "+", "1", "23", "4111111111111111", "\n", "é", "_", "(", ")", "255", "10.0.0.1", "x@y.zz", "  "]
    texts = HAND + ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    got = {r.doc_id: r for r in pii.personal_data(rows_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (t, want, r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        shown = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(shown) and len(shown) == len(want) + r.n_added
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in shown]
        assert order == sorted(order)


def test_wide_spans_are_added_where_the_corpus_supports_them(spark):
    rng = random.Random(2)
    texts = [f"please call {rng.randint(200, 999)} now: +1 (683) 555-{rng.randint(1000, 9999)} thanks" for _ in range(300)]
    texts += [f"write to user{k} [at] mail{k % 7} [dot] com soon" for k in range(400)]
    texts += ["version 1.2.3 of 2024, figures 12 34 and 100 200"] * 50
    got = pii.personal_data(rows_of(spark, texts)).collect()
    assert sum(r.n_added for r in got if 300 <= r.doc_id < 700) == 400
    assert all(r.spans == "" for r in got if r.doc_id >= 700)
    assert all(r.spans.startswith("email:9:") for r in got if 300 <= r.doc_id < 700)
    assert all(r.n_phone == 1 for r in got if r.doc_id < 300)
    for r in got:       # added spans never touch a base span
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_wide_spans_reach_beyond_base_spans(spark):
    texts = [f"ask m\u00fcller{k}@firma{k % 5}.de now" for k in range(300)] + [f"ask a{k}@mail.example [dot] com now" for k in range(300)]
    texts += [f"ask b{k}@mail{k % 7}.com now" for k in range(300)]
    docs = rows_of(spark, texts)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_email == 1
        assert got[i].n_added == (i < 600) and (i < 600 or got[i].spans == want)
        assert i >= 600 or f"email:4:{len(t) - 4}" in got[i].spans.split(",")
    assert {r.text for r in pii.redact(docs).collect()} == {"ask <EMAIL> now"}


def test_only_spans_that_overlap_a_better_one_give_way(spark, monkeypatch):
    # kinds 0..3 overlap in a chain: 0-10, 8-20, 18-30, 28-40 and one alone at 50
    rows = [(1, 0, 0, 10, 0.95), (1, 1, 8, 20, 0.99), (1, 2, 18, 30, 0.96), (1, 3, 28, 40, 0.94), (1, 0, 50, 60, 0.93)]
    wide = spark.createDataFrame([(k, "x", a, b, True, kind, s, False) for k, kind, a, b, s in rows],
                                 "key long, m string, start long, end long, wide boolean, kind int, s double, covered boolean")
    monkeypatch.setattr(pii, "labelled", lambda found: wide)
    monkeypatch.setattr(pii, "train", lambda found: (None, {k: 0.9 for k in range(4)}))
    monkeypatch.setattr(pii, "sql_score", lambda model: pii.F.col("s"))
    _, chosen = pii.spans(rows_of(spark, [""]))
    assert sorted((r.start, r.end, r.kind) for r in chosen.collect()) == [(8, 20, 1), (28, 40, 3), (50, 60, 0)]


def test_redaction_keeps_rows_and_columns(spark):
    texts = ["mail a@b.co or call +1 683 555 0123!", "clean", None, "", "mail a@b.co or call +1 683 555 0123!", "4111 1111 1111 1111"]
    docs = rows_of(spark, texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()))
    assert got == [(0, "mail <EMAIL> or call <PHONE>!"), (1, "clean"), (2, None), (3, ""), (4, "mail <EMAIL> or call <PHONE>!"), (5, "<CARD>")]


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (None, None)], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.n_email, r.spans)) for r in pii.personal_data(docs).collect())
    assert got == sorted(map(str, [(1, 1, "email:0:6"), (1, 1, "email:0:6"), (None, 1, "email:0:6"), (None, 0, "")]))
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
