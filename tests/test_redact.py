"""Redaction chain: expected texts and counts written out by hand. The oracle SQL judges
the chain on every résumé of the fixture (test_entry)."""

import random

from conftest import one_col
from test_text import ALPHABET

from hirelens.functions import fixed
from hirelens.operators.redact import detect_candidate_name, redact


def _redact(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = redact(df, "text").orderBy("i").collect()
    return [(r.redacted_text, {k: n for k, n in r.redactions.asDict().items() if n}, r.total_redactions, r.candidate_name_detected)
            for r in out]


N, M, U, A, P, T, L, F_ = (fixed.TOKENS[k] for k in (
    "name", "email", "url", "aadhaar", "pan", "phone", "address", "sensitive_fields"))

GOLDEN = [
    ("+919876543210", f"+{A}", {"aadhaar": 1}),
    ("+91 98765 43210", T, {"phone": 1}),
    ("(987) 654-3210", f"({T}", {"phone": 1}),
    ("card 1234567812345678 stays", "card 1234567812345678 stays", {}),
    ("1234\n5678\n9012", A, {"aadhaar": 1}),
    ("Aadhaar: 1234 5678 9012", F_, {"aadhaar": 1, "sensitive_fields": 1}),
    ("Priya Nair\nsomething on planet earth", f"{N}\n{L}", {"name": 1, "address": 1}),
    ("\n".join(["l"] * 12 + ["12 street"]), "\n".join(["l"] * 12 + ["12 street"]), {}),
    ("text with final newline\n", "text with final newline", {}),
    ("Priya  Nair\nnothing else", "Priya  Nair\nnothing else", {}),
    ("Priya  Nair\nabout priya nair", f"Priya  Nair\nabout {N}", {"name": 1}),
    ("Curriculum Vitae\nSenior Data Engineer\nJOHN B SMITH\nx", f"Curriculum Vitae\nSenior Data Engineer\n{N}\nx", {"name": 1}),
    ("Mail x.y@mail.example.com or visit https://foo.io/bar and www.site.org",
     f"Mail {M} or visit {U} and {U}", {"email": 1, "url": 2}),
    ("see LinkedIn.com/in/x; github.com/y", f"see {U} {U}", {"url": 2}),
    ("PAN abcde1234f and ABCDE1234F", f"PAN {P} and {P}", {"pan": 2}),
    ("xABCDE1234F ABCDE1234FG", "xABCDE1234F ABCDE1234FG", {}),
    ("DOB: 01-02-1990\n  Father's Name - X\nmarital status : single", f"{F_}\n{F_}\n{F_}", {"sensitive_fields": 3}),
    ("12 Lake Road, Pune 411001", L, {"address": 1}),
    ("ip 192.168.100.200 here", f"ip {T} here", {"phone": 1}),
    ("a@b.co", M, {"email": 1}),
    ("", "", {}),
]


def test_goldens(spark):
    got = _redact(spark, [t for t, _, _ in GOLDEN])
    for (text, want, counts), (out, mine, total, _) in zip(GOLDEN, got):
        assert (out, mine, total) == (want, counts, sum(counts.values())), text
    assert got[9][3] and not got[8][3]


def test_names(spark):
    cases = {"Curriculum Vitae\nJOHN B SMITH": "JOHN B SMITH", "Senior Data Engineer\nPriya Nair": "Priya Nair",
             "Anne-Marie O'Neil": "Anne-Marie O'Neil", "Madonna": None, "One Two Three Four Five Six": None,
             "a\nb\nc\nd\nJohn Smith": None, "a\n\n \nb\nc\nJohn   Smith": "John Smith", "john smith": None,
             "Dr. John Smith": "Dr. John Smith", "J0hn Smith": None,
             "\n" * 40 + "x\n\n" * 2 + "Jane Doe\nmore": "Jane Doe", "\n" * 40 + "x\n" * 4 + "Jane Doe": None}
    assert one_col(spark, list(cases), detect_candidate_name) == list(cases.values())


def test_invariants_on_random_texts(spark):
    rnd = random.Random(11)
    extra = ["Road", "lane", "411001", "DOB: ", "Gender - ", "www.x.io/a", "ABCDE1234F", "Priya Nair\n"]
    texts = ["".join(rnd.choice(ALPHABET + extra) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    keys = {k: fixed.TOKENS[k] for k in fixed.REDACTION_KEYS}
    for text, (out, counts, total, _) in zip(texts, _redact(spark, texts)):
        assert total == sum(counts.values())
        assert all(token not in out or counts.get(k) for k, token in keys.items()), text
        assert (total > 0) or out.rstrip("\n") == "\n".join(text.splitlines()).rstrip("\n"), text
        assert "x@y.co" not in out or "x@y.co" in text


def test_passes_by_line_equal_whole_text_patterns(spark):
    """Emails, phones and links looked for where they can be are those of a pattern over the whole
    text, and no line-break class is tried at every character."""
    import re

    from hirelens.operators.redact import PHONE_CANDIDATE, URL, _count, redact_emails, redact_pattern, redact_phone_numbers

    w = r"[^\W]"
    email = re.compile(rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))" + fixed.EMAIL_CORE + rf"(?!{w})")
    phone = re.compile(r"(?<!\d)(?:\+?\d[\d ().-]{8,}\d)(?!\d)")
    url = re.compile(rf"(?<!{w})(?:https?://|www\.)\S+|(?<!{w})(?:linkedin\.com|github\.com)/\S+", re.I)
    rnd = random.Random(5)
    parts = ["a", "é", "ß", "_", "-", ".", "+", " ", "\n", "\r", "\x85", "@", "@y.co", ".x@y.org", "x@y.co_", "1", "+91 98765", " 43210",
             "(020) ", "٣٤٥", "123456", "12345678901234", "WWW.", "www.", "http://", "httpſ://", "GitHub.com/", "linKedin.com/", "x"]
    texts = ["", "\n", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(400)]]

    def subbed(pattern, token, ok=lambda m: True):
        hits = [[m for m in pattern.finditer(t) if ok(m[0])] for t in texts]
        return [(pattern.sub(lambda m: token if ok(m[0]) else m[0], t), len(h)) for t, h in zip(texts, hits)]

    def got(fn):
        from pyspark.sql import functions as F
        return [tuple(r) for r in one_col(spark, texts, lambda c: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(fn(c))]))]

    assert got(redact_emails) == subbed(email, M)
    assert got(redact_phone_numbers) == subbed(phone, T, lambda m: 10 <= sum(ch.isdecimal() for ch in m) <= 13)
    assert got(lambda c: redact_pattern(c, URL, U)) == subbed(url, U)
    assert one_col(spark, texts, lambda c: _count(c, PHONE_CANDIDATE)) == [len(phone.findall(t)) for t in texts]

    df = redact(spark.createDataFrame([(1, "x")], "i int, text string"), "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__other" in plan and r"(?<=\n)" not in plan
