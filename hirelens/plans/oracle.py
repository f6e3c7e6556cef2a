"""DuckDB SQL for the correctness oracle.

Each helper returns SQL text mirroring one Spark column function. DuckDB
uses RE2 (no look-around), so boundary rules are rewritten as consuming
groups where only existence matters, and counted rules use a
separator-doubling rewrite so neighbouring matches cannot steal each
other's boundary characters.
"""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import _fold_to_ascii_letters
from ..operators.similarity import C2
from ..operators.skills import _norm
from ..sources.tables import view_sql

WS_BODY = r"\x09-\x0d\x1c-\x20\x{85}\pZ"
WS = f"[{WS_BODY}]"
NWS = f"[^{WS_BODY}]"
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"
LB = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]::VARCHAR[]"


def splitlines(x: str) -> str:
    return (f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array("
            f"regexp_replace({x}, '(?:{LB})$', ''), '{LB}') END)")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{NWS}+')) AS BIGINT)"


def clean_text(x: str) -> str:
    t = f"replace(replace({x}, chr(160), ' '), chr(8203), '')"
    inner = strip(r"regexp_replace(l, '[ \t]+', ' ', 'g')")
    lines = f"list_transform({splitlines(t)}, lambda l: {inner})"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


def nonblank_lines(x: str) -> str:
    return f"list_filter(list_transform({splitlines(x)}, lambda l: {strip('l')}), lambda l: l <> '')"


def casefold_ascii(x: str) -> str:
    out = f"lower({x})"
    for ch, folded in _fold_to_ascii_letters():
        out = f"replace({out}, {lit(ch)}, {lit(folded)})"
    return out


def normalize_heading(x: str) -> str:
    t = strip(casefold_ascii(x))
    t = f"regexp_replace({t}, '[^a-z{WS_BODY}]', '', 'g')"
    return strip(collapse(t))


def py_round2(x: str) -> str:
    """Python round(x, 2) on the exact binary value (see functions.text.py_round2)."""
    s = "CAST(134217729 AS DOUBLE)"
    h = "CAST(100 AS DOUBLE)"
    return (f"(SELECT (n + CASE WHEN f > 0.5 THEN 1 WHEN f < 0.5 THEN 0 WHEN e > 0 THEN 1 "
            f"WHEN e < 0 THEN 0 WHEN floor(n / 2) * 2 = n THEN 0 ELSE 1 END) / {h} "
            f"FROM (SELECT n, p - n AS f, e FROM (SELECT floor(p) AS n, p, (hi * {h} - p) + (x - hi) * {h} AS e "
            f"FROM (SELECT x, p, c - (c - x) AS hi FROM (SELECT x, x * {h} AS p, x * {s} AS c "
            f"FROM (SELECT CAST({x} AS DOUBLE) AS x))))))")


# ---------------------------------------------------------------------------
# Skills
# ---------------------------------------------------------------------------
EDGE = r"[\pL\pN_+#]"
NOT_EDGE = r"[^\pL\pN_+#]"


def skill_list(norm: str, catalog: dict[str, list[str]]) -> str:
    parts = []
    for name, aliases in catalog.items():
        alts = "|".join(r"\Q" + _norm(a) + r"\E" for a in aliases)
        pat = f"(^|{NOT_EDGE})(?:{alts})($|{NOT_EDGE})"
        parts.append(f"CASE WHEN regexp_matches({norm}, {lit(pat)}) THEN {lit(name)} END")
    return f"list_sort(list_filter([{', '.join(parts)}], lambda s: s IS NOT NULL))"


# ---------------------------------------------------------------------------
# Similarity
# ---------------------------------------------------------------------------
def tokens(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '{W}{{2,}}'), "
            f"lambda w: NOT list_contains({lst(fixed.ENGLISH_STOP_WORDS)}, w))")


def terms_cte(name: str, src: str, id_col: str) -> str:
    return f"""{name} AS (
  SELECT {id_col} AS id, term, CAST(count(*) AS BIGINT) AS tf FROM (
    SELECT {id_col}, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN
             list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
             ELSE []::VARCHAR[] END)) AS term
    FROM (SELECT {id_col}, {tokens('text')} AS t FROM {src}))
  GROUP BY ALL)"""


def cosine(dot: str, rr: str, jj: str, sr: str, sj: str) -> str:
    c2 = f"CAST({lit(repr(C2))} AS DOUBLE)"
    om = f"CAST({lit(repr(1.0 - C2))} AS DOUBLE)"
    nr = f"({c2} * CAST({sr} AS DOUBLE) + {om} * CAST({rr} AS DOUBLE))"
    nj = f"({c2} * CAST({sj} AS DOUBLE) + {om} * CAST({jj} AS DOUBLE))"
    x = f"(CAST({dot} AS DOUBLE) / sqrt({nr} * {nj}) * CAST(100 AS DOUBLE))"
    return f"CASE WHEN coalesce({dot}, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE {py_round2(x)} END"


# ---------------------------------------------------------------------------
# Scorecard predicates
# ---------------------------------------------------------------------------
_EMAIL_TAIL = r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}($|[^\pL\pN_])"
EMAIL_EXISTS = (rf"(^|{NW})[A-Za-z0-9_][A-Za-z0-9._%+-]*{_EMAIL_TAIL}"
                rf"|{W}[.%+-][A-Za-z0-9._%+-]*{_EMAIL_TAIL}")
PHONE_EXISTS = rf"(?:\p{{Nd}}[{WS_BODY}().-]*){{10}}"
LINK_EXISTS = r"(?i)linkedin\.com|github\.com|portfolio|https?://|www\."


def date_count(x: str) -> str:
    doubled = f"(' ' || regexp_replace({x}, '({NW})', '\\1\\1', 'g') || ' ')"
    pat = (f"(?i){NW}(?:(?:{fixed.MONTH_PATTERN}){WS}+(?:19|20)\\p{{Nd}}{{2}}"
           f"|(?:19|20)\\p{{Nd}}{{2}}){NW}")
    return f"CAST(len(regexp_extract_all({doubled}, {lit(pat)})) AS BIGINT)"


def unusual_ratio(x: str) -> str:
    allowed = "".join("\\" + c if c in "\\[]^-" else c for c in fixed.ALLOWED_SYMBOLS)
    kept = f"length(regexp_replace({x}, {lit('[\\pL\\pN' + WS_BODY + allowed + ']')}, '', 'g'))"
    return f"CASE WHEN length({x}) = 0 THEN CAST(1 AS DOUBLE) ELSE {kept} / length({x}) END"


def heading_lines(x: str) -> str:
    return (f"list_transform(list_filter({splitlines(x)}, lambda l: length({strip('l')}) BETWEEN 1 AND 50), "
            f"lambda l: {normalize_heading('l')})")


def section_flags(heads: str) -> str:
    return ", ".join(f"list_has_any({heads}, {lst(aliases)}) AS {name}"
                     for name, aliases in fixed.SECTION_ALIASES.items())


def ladder(branches: list[tuple[str | None, int, str]]) -> tuple[str, str]:
    p = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in branches if c) + \
        f" ELSE {branches[-1][1]} END"
    m = "CASE " + " ".join(f"WHEN {c} THEN {lit(t)}" for c, _, t in branches if c) + \
        f" ELSE {lit(branches[-1][2])} END"
    return p, m


def checks_sql() -> list[tuple[str, str, int]]:
    """(points SQL, message SQL, maximum) per check over the feature columns."""
    m = fixed.MSG
    out = []

    def flag(cond, pts, yes, no):
        out.append((f"CASE WHEN {cond} THEN {pts} ELSE 0 END",
                    f"CASE WHEN {cond} THEN {lit(yes)} ELSE {lit(no)} END", pts))

    p, t = ladder([("words >= 100", 20, m["parse_20"]), ("words >= 50", 10, m["parse_10"]),
                   (None, 0, m["parse_0"])])
    out.append((p, t, 20))
    flag("email", 7, m["email_yes"], m["email_no"])
    flag("phone", 6, m["phone_yes"], m["phone_no"])
    flag("link", 2, m["link_yes"], m["link_no"])
    for name, pts in fixed.SECTION_POINTS:
        flag(name, pts, m["section_yes"].format(name=name), m["section_no"].format(title=name.title()))
    flag("(projects OR certifications)", 4, m["optional_yes"], m["optional_no"])
    p, t = ladder([("dates >= 2", 10, m["dates_2"]), ("dates = 1", 5, m["dates_1"]),
                   (None, 0, m["dates_0"])])
    out.append((p, t, 10))
    p, t = ladder([("words BETWEEN 250 AND 1000", 10, m["length_10"]),
                   ("words BETWEEN 150 AND 1500", 7, m["length_7"]), (None, 3, m["length_3"])])
    out.append((p, t, 10))
    sup = "lower(extension) IN ('.pdf', '.docx')"
    out.append((f"CASE WHEN {sup} THEN 5 ELSE 0 END",
                f"CASE WHEN {sup} THEN upper(extension) || ' is a supported format.' "
                f"ELSE {lit(m['format_no'])} END", 5))
    p, t = ladder([("ratio <= 0.01", 5, m["chars_5"]), ("ratio <= 0.03", 3, m["chars_3"]),
                   (None, 0, m["chars_0"])])
    out.append((p, t, 5))
    p, t = ladder([("n_lines >= 8 AND longest <= 300", 5, m["structure_5"]),
                   ("n_lines >= 4", 3, m["structure_3"]), (None, 0, m["structure_0"])])
    out.append((p, t, 5))
    return out


def features_cte(src: str) -> str:
    """Per-résumé features shared by the scorecard queries."""
    heads = heading_lines("text")
    nb = nonblank_lines("text")
    return f"""feat AS (
  SELECT resume_id, extension, {word_count('text')} AS words,
         {section_flags('heads')},
         regexp_matches(text, {lit(EMAIL_EXISTS)}) AS email,
         regexp_matches(text, {lit(PHONE_EXISTS)}) AS phone,
         regexp_matches(text, {lit(LINK_EXISTS)}) AS link,
         {date_count('text')} AS dates,
         {unusual_ratio('text')} AS ratio,
         CAST(len(nb) AS BIGINT) AS n_lines,
         CAST(coalesce(list_max(list_transform(nb, lambda l: length(l))), 0) AS BIGINT) AS longest
  FROM (SELECT *, {heads} AS heads, {nb} AS nb FROM {src}))"""


def score_cte() -> str:
    cs = checks_sql()
    pts = ", ".join(f"{p}" for p, _, _ in cs)
    msgs = ", ".join(f"{t}" for _, t, _ in cs)
    maxima = ", ".join(str(mx) for _, _, mx in cs)
    names = lst(fixed.CHECK_NAMES)
    missing = " || ".join(
        f"CASE WHEN NOT {n} THEN {lit(n + ',')} ELSE '' END" for n in fixed.SECTION_NAMES)
    return f"""card AS (
  SELECT resume_id, words AS word_count, pts, msgs, {names} AS names, [{maxima}] AS maxima,
         CAST(list_sum(pts) AS BIGINT) AS score,
         rtrim({missing}, ',') AS missing_sections, *
  FROM (SELECT *, [{pts}] AS pts, [{msgs}] AS msgs FROM feat))"""


def rating(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} >= {t} THEN {lit(l)}" for t, l in fixed.RATINGS)
            + f" ELSE {lit(fixed.RATING_FLOOR)} END")


# ---------------------------------------------------------------------------
# Redaction rules that RE2 can express
# ---------------------------------------------------------------------------
PIN_EXISTS = rf"(^|{NW})[1-9][0-9]{{5}}($|{NW})"


def address_line(x: str) -> str:
    low = casefold_ascii(x)
    words = " OR ".join(f"contains({low}, {lit(w)})" for w in fixed.ADDRESS_WORDS)
    return f"({words} OR regexp_matches({x}, {lit(PIN_EXISTS)}))"


SENSITIVE = rf"(?i)^{WS}*(?:" + "|".join(fixed.SENSITIVE_LABELS) + rf"){WS}*[:\-]"


def name_candidate(x: str) -> str:
    cands = f"list_transform(list_slice({nonblank_lines(x)}, 1, {fixed.HEADER_NAME_LINES}), lambda l: {collapse('l')})"
    cond = (f"NOT list_contains({lst(fixed.NAME_EXCLUSIONS)}, lower(n)) "
            f"AND NOT list_has_any(string_split(lower(n), ' '), {lst(fixed.ROLE_WORDS)}) "
            f"AND NOT contains(n, '@') AND NOT regexp_matches(n, '\\p{{Nd}}') "
            f"AND regexp_full_match(n, {lit(chr(91) + 'A-Za-z][A-Za-z .' + chr(39) + '’-]+')}) "
            f"AND len(string_split(n, ' ')) BETWEEN 2 AND 5 "
            f"AND (NOT regexp_matches(n, '[a-z]') OR "
            f"list_bool_and(list_transform(string_split(n, ' '), lambda w: regexp_matches(left(w, 1), '[A-Z]'))))")
    return f"list_filter({cands}, lambda n: {cond})[1]"


# Chained redaction. Look-arounds become literals: every run of word characters (or digits) is
# wrapped in two control characters that the data doesn't hold, the rule is written with them, and
# they are taken out again.
_S, _E, _PLUS = r"\x01", r"\x02", r"\x03"
_ND = r"\p{Nd}"
_PAN_LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
_RULES = {
    "email": (W, rf"[{_S}{_E}]+[A-Za-z0-9._%+-][A-Za-z0-9._%+\-{_S}{_E}]*@[{_S}{_E}]*[A-Za-z0-9.-][A-Za-z0-9.\-{_S}{_E}]*"
                 rf"\.{_S}[A-Za-z]{{2,}}{_E}"),
    "url": (W, rf"{_S}(?i:https?){_E}+://{NWS}+|{_S}(?i:www){_E}+\.{NWS}+|{_S}(?i:linkedin|github){_E}+\.{_S}(?i:com){_E}+/{NWS}+"),
    "aadhaar": (_ND, rf"{_S}{_ND}{{4}}(?:{_ND}{{4}}|{_E}+{WS}?{_S}{_ND}{{4}}){{2}}{_E}"),
    "pan": (W, rf"{_S}{_PAN_LETTER}{{5}}[0-9]{{4}}{_PAN_LETTER}{_E}"),
}
_PHONE = rf"\+?{_S}[{_ND} ().\-{_S}{_E}]*{_E}"


def _wrapped(x: str, run: str) -> str:
    return f"regexp_replace({x}, '({run}+)', chr(1) || '\\1' || chr(2) || chr(2), 'g')"


def _plain(x: str) -> str:
    return f"translate({x}, chr(1) || chr(2), '')"


def redaction_ctes(src: str) -> str:
    """CTEs ending in ``red(resume_id, name, text, c_<key>..., total)``."""
    name_rx = "'(?i)' || regexp_escape(name)"
    out = [f"r_0 AS (SELECT resume_id, text AS t, {name_candidate('text')} AS name FROM {src})",
           f"""r_name AS (SELECT resume_id, name,
       CASE WHEN name IS NULL THEN t ELSE regexp_replace(t, {name_rx}, {lit(fixed.TOKENS['name'])}, 'g') END AS t,
       CASE WHEN name IS NULL THEN 0 ELSE len(regexp_extract_all(t, {name_rx})) END AS c_name FROM r_0)"""]
    last = "r_name"
    for key, (run, rule) in _RULES.items():
        out.append(f"w_{key} AS (SELECT * EXCLUDE (t), {_wrapped('t', run)} AS w FROM {last})")
        out.append(f"""r_{key} AS (SELECT * EXCLUDE (w), {_plain(f"regexp_replace(w, {lit(rule)}, {lit(fixed.TOKENS[key])}, 'g')")} AS t,
       len(regexp_extract_all(w, {lit(rule)})) AS c_{key} FROM w_{key})""")
        last = f"r_{key}"
    # a plus sign right after a digit is no part of a number
    out.append(f"""w_phone AS (SELECT * EXCLUDE (t),
       regexp_replace({_wrapped('t', _ND)}, '{_E}\\+{_S}', chr(2) || chr(3) || chr(1), 'g') AS w FROM {last})""")
    out.append(f"""m_phone AS (SELECT *, regexp_split_to_array(w, {lit(_PHONE)}) AS ps,
       list_transform(regexp_extract_all(w, {lit(_PHONE)}), lambda m: CASE WHEN length(translate(m, chr(1) || chr(2) || '+', '')) >= 10
            AND length(regexp_replace(m, '\\P{{Nd}}', '', 'g')) BETWEEN 10 AND 13 THEN {lit(fixed.TOKENS['phone'])} ELSE m END) AS ms
       FROM w_phone)""")
    out.append(f"""r_phone AS (SELECT * EXCLUDE (w, ps, ms), replace({_plain("array_to_string(list_transform(ps, lambda p, i: p || coalesce(ms[i], '')), '')")},
       chr(3), '+') AS t, len(list_filter(ms, lambda m: m = {lit(fixed.TOKENS['phone'])})) AS c_phone FROM m_phone)""")
    lines = splitlines("t")
    out.append(f"""r_address AS (SELECT * EXCLUDE (t), array_to_string(list_transform({lines}, lambda l, i: CASE WHEN i <= {fixed.HEADER_ADDRESS_LINES}
            AND {address_line('l')} THEN {lit(fixed.TOKENS['address'])} ELSE l END), chr(10)) AS t,
       len(list_filter(list_slice({lines}, 1, {fixed.HEADER_ADDRESS_LINES}), lambda l: {address_line('l')})) AS c_address FROM r_phone)""")
    hit = f"regexp_matches(l, {lit(SENSITIVE)})"
    out.append(f"""r_sensitive_fields AS (SELECT * EXCLUDE (t), array_to_string(list_transform({lines}, lambda l: CASE WHEN {hit}
            THEN {lit(fixed.TOKENS['sensitive_fields'])} ELSE l END), chr(10)) AS text,
       len(list_filter({lines}, lambda l: {hit})) AS c_sensitive_fields FROM r_address)""")
    total = " + ".join(f"c_{k}" for k in fixed.REDACTION_KEYS)
    out.append(f"red AS (SELECT *, {total} AS total FROM r_sensitive_fields)")
    return ",\n".join(out)


def v(name: str) -> str:
    return f"({view_sql(name)})"
