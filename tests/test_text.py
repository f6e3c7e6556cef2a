"""Text rules vs Python's own str/re on adversarial strings."""

import random
import unicodedata

from conftest import one_col
from pyspark.sql import functions as F

from hirelens.functions import text as X

ALPHABET = (list("ab Z9_.-@+#()\t\n\r") + ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85",
            "\xa0", "\u2002", "\u202f", "\u3000", "\u200b", "\u2028", "\xe9", "\xdf", "\ufb01",
            "\u0663", "\xb2", "\xbd", "\u2022", "\u2014", "\u0130", "\u212a",
            "\r\n", "  ", "2019", "Jan ", "1234 5678 9012", "+91 98765 43210", "x@y.co"])


def rand_strings(n, seed, max_len=25):
    rnd = random.Random(seed)
    out = ["", " ", "\n", "a\n", "\n\n", "a\r\nb\r\n"]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))))
    return out


def test_splitlines_strip_wordcount(spark):
    vals = rand_strings(400, 1)
    assert one_col(spark, vals, X.splitlines) == [v.splitlines() for v in vals]
    assert one_col(spark, vals, X.strip) == [v.strip() for v in vals]
    assert one_col(spark, vals, X.word_count) == [len(v.split()) for v in vals]
    assert one_col(spark, vals, X.join_lines) == ["\n".join(v.splitlines()) for v in vals]
    assert one_col(spark, vals, X.nonblank_stripped_lines) == [
        [ln.strip() for ln in v.splitlines() if ln.strip()] for v in vals]


def test_clean_text(spark):
    cases = {"": "", " \t ": "", "a  b\t c": "a b c", "first  page \n\n\nsecond\xa0 page": "first page\nsecond page",
             "zero\u200bwidth": "zerowidth", "a\r\n\x0b b \x85c\u2028": "a\nb\nc", "\u2002x\u2002y": "x\u2002y"}
    assert one_col(spark, list(cases), X.clean_text) == list(cases.values())
    for v, out in zip(vals := rand_strings(300, 2), one_col(spark, vals, X.clean_text)):
        lines = out.split("\n") if out else []
        assert all(ln and ln == ln.strip() and "  " not in ln and "\t" not in ln for ln in lines), v
        assert "".join(out.split()) == "".join(v.replace("\u200b", "").split())


def test_predicates(spark):
    dates = {"": 0, "2019": 1, "x2019": 0, "\xe92019": 0, "Jan 2019 - March 2021 and 2020": 3, "1899 2100": 0, "Sept  1999": 1, "20190": 0}
    assert one_col(spark, list(dates), X.date_count) == list(dates.values())
    phones = {"(987) 654-3210": True, "1234567890123456": True, "123 456 789": False, "call 2018 - 2020, 2021": False,
              "+91 98765 43210": True, "2018 - 2020 - 2021": True, "": False}
    assert one_col(spark, list(phones), X.has_phone) == list(phones.values())
    mails = {"x@y.co": True, "x@y.c": False, "x@y": False, "a.b+c@d-e.f.org!": True, "@y.com": False, "x@y.co_": False}
    assert one_col(spark, list(mails), X.has_email) == list(mails.values())
    ratios = {"": 1.0, "abc": 0.0, "a$": 0.5, "\xe9 \u0663": 0.0, "$$$$": 1.0}
    assert one_col(spark, list(ratios), X.unusual_ratio) == list(ratios.values())


def test_normalize_and_headings(spark):
    vals = ["ＰＹＴＨＯＮ", "Straße", "Certiﬁcations", "ǰava", "ΐjava", "plain", None]
    got = one_col(spark, vals, X.normalize_text)
    assert got[:3] == ["python", "strasse", "certifications"]
    assert got == [v and unicodedata.normalize("NFKC", v).casefold() for v in vals]
    heads = ["SKILLS:", "Technical   Skills", "Skills & Tools", "Certiﬁcations", " Work\tExperience "]
    exp = []
    for h in heads:
        import re
        t = re.sub(r"[^a-z\s]", "", h.casefold().strip())
        exp.append(re.sub(r"\s+", " ", t).strip())
    assert one_col(spark, heads, X.normalize_heading) == exp


def test_py_round2_matches_python(spark):
    rnd = random.Random(7)
    vals = [2.675, 3.125, 0.125, 1.005, 31.205, 12.345, 66.66666666666667, 0.0, 100.0]
    vals += [rnd.randint(0, 10**6) / 1000 * rnd.choice([1, 1.0000000000000002, 0.9999999999999998])
             for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(X.py_round2("x")).collect()]
    assert got == [round(v, 2) for v in vals]
    ints = [0.5, 1.5, 2.5, -0.5, 99.5, 100.4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ints)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(X.py_round_int("x")).collect()] == [round(v) for v in ints]


def test_casefold_table_is_rule_derived():
    pairs = dict(X._fold_to_ascii_letters())
    assert pairs["ß"] == "ss" and pairs["ﬁ"] == "fi" and len(pairs) == 17
    assert F is not None


def test_strip_characters_are_the_whitespace_class(spark):
    """The characters stripped natively are those of the pattern class, no more and no less."""
    from hirelens.functions.text import WS, WS_CHARS
    every = [chr(i) for i in range(0x10000) if not 0xd800 <= i < 0xe000]
    assert "".join(c for c, hit in zip(every, one_col(spark, every, lambda x: x.rlike(WS))) if hit) == WS_CHARS


def test_lines_and_headers_against_python(spark):
    """Line joins, header addresses and sensitive lines of texts with every kind of line break."""
    import random
    import re

    from hirelens.functions import fixed
    from hirelens.functions.text import join_lines, splitlines, unusual_ratio
    from hirelens.operators.redact import header_addresses, sensitive_lines

    rng = random.Random(4)
    parts = ["\n", "\r\n", "\r", "\x0b", "\x85", " ", "x", "Lake Road", "PIN 411001", "DOB: 1", "sex - m", "", " ", "ﬂat", "STREET ß"]
    texts = ["", "\n", "a\n", "a\r\n", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(120)], None]
    joined = [None if t is None else "\n".join(t.splitlines()) for t in texts]
    assert one_col(spark, texts, join_lines) == joined
    assert one_col(spark, texts, splitlines) == [None if t is None else t.splitlines() for t in texts]

    def address(line):
        return any(w in line.casefold() for w in fixed.ADDRESS_WORDS) or re.search(r"\b[1-9][0-9]{5}\b", line)

    def header(t):
        if t is None:
            return None
        lines = "\n".join(t.splitlines()).split("\n")
        return ("\n".join(fixed.TOKENS["address"] if i < 12 and address(x) else x for i, x in enumerate(lines)),
                sum(1 for x in lines[:12] if address(x)))

    assert [r and tuple(r) for r in one_col(spark, texts, header_addresses)] == [header(t) for t in texts]
    labels = re.compile(r"(?i)\s*(?:" + "|".join(fixed.SENSITIVE_LABELS) + r")\s*[:\-]")
    want = [t and ("\n".join(fixed.TOKENS["sensitive_fields"] if labels.match(x) else x for x in t.splitlines()),
                   sum(1 for x in t.splitlines() if labels.match(x))) for t in texts]
    assert [r and (tuple(r) if t else t) for r, t in zip(one_col(spark, texts, sensitive_lines), texts)] == want
    assert one_col(spark, ["a~~b^", "", "~", "ok"], unusual_ratio) == [3 / 5, 1.0, 1.0, 0.0]


def test_a_table_in_one_row_group_is_dealt_out(spark, tmp_path):
    """A large share of one task is dealt to more, rows unchanged; small or even tables are left as they are."""
    from pyspark.sql import functions as F

    from hirelens.sources.tables import spread
    for n, more in ((100, False), (9000, True)):
        at = str(tmp_path / f"t{n}")
        spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit("t").alias("text")).coalesce(1).write.parquet(at)
        df = spark.read.parquet(at)
        out = spread(df, df)
        assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
        tasks = out.groupBy(F.spark_partition_id()).count().count()
        assert (tasks > 4) if more else (tasks == 1)
    even = spark.range(0, 40000, 1, 8)
    assert spread(even, even) is even
