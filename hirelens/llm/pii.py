"""Personal data by candidate gradient boosting (operator 2), DataFrame functions only.

1. Generators. Per kind (email, ip, card, phone) a base pattern with its check
   and a wider, high-recall pattern propose spans; spans of different generators
   may overlap. A text is scanned once; positions come from the lengths of the
   parts between matches, summed over a text's own candidates.
2. Boosted trees. Format and context features of the wide candidates take few
   values each, so candidates are counted per distinct feature vector (a grid
   bounded by the features, not by the data) over *all* documents. Trees are
   fitted to that table; weak labels say whether a candidate holds a base span
   of its kind or a strong cue (``weak_cue``: a spelled-out at sign, an address of
   colon groups, a number right after its cue word). Trees become CASE expressions.
3. Calibrated thresholds. Per kind, the least score at which the held-out fold
   of vectors reaches ``PRECISION`` with a Wilson bound; without one, none.
   Selected wide spans are added where they reach beyond the base spans (which stay)
   and overlap no better added one.

The patterns are written without backtracking loops (possessive repeats, a
look-behind for the start of a run), which leaves their leftmost matches as they
are and keeps long runs linear.

Defined results: null or empty text has no spans; repeated rows each keep their
spans; null ids and extra columns are allowed; an empty table gives no rows and
trains nothing. In ``redact``, texts of null stay null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import keep, row_key
from hirelens.llm.quality import Trees, fit

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
CONTEXT = 24
DEPTH, ROUNDS = 3, 24

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[\p{L}\p{N}-]++"
             r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9])++(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9]{1,4}(?:\)?[\x20./-]\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])",
}
# cheap conditions that every match of the kind's patterns meets
_NEED = {"email": r"[@]|[\[(]at[\])]", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": r"[0-9][\x20.-]?[0-9]", "phone": "[0-9]"}
_CUES = r"(?i)tel|phone|call|fax|mobil|card|visa|credit|mail|contact|\bip\b|address|server|host"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
FEATURES = ("kind", "digits", "parts", "left", "right", "cue", "mark", "size", "letters")


# ------------------------------------------------------------ candidates

def _matches(text: str, pattern: str) -> str:
    """SQL: for each match its text, the length of what lies before it since the last match, and its surroundings."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    # the one-element array binds the two scans to a name
    return (f"element_at(transform(array(struct(regexp_extract_all({text}, '{p}', 0) AS m, split({text}, '{p}', -1) AS p)), "
            f"z -> zip_with(zip_with(z.m, slice(z.p, 1, size(z.m)), (m, p) -> struct(m AS m, p AS p)), "
            f"slice(z.p, 2, size(z.m)), (x, q) -> struct(x.m AS m, cast(char_length(x.p) AS bigint) AS gap, "
            f"right(x.p, {CONTEXT}) AS before, left(q, {CONTEXT}) AS after))), 1)")


_FOUND = "array<struct<m:string,gap:bigint,before:string,after:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found): the candidates of every text, still without positions."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text"))
    cols = []
    for kind in KINDS:
        need = _NEED[kind].replace("\\", "\\\\")
        for gen, patterns in (("base", BASE), ("wide", WIDE)):
            cols.append(F.expr(
                f"CASE WHEN text RLIKE '{need}' THEN {_matches('text', patterns[kind])} END").cast(_FOUND).alias(f"{kind}_{gen}"))
    return base.select("doc_id", "key", *cols)


def candidates(scanned: DataFrame) -> DataFrame:
    """(key, kind, wide, m, start, end, before, after): positions in code points, end exclusive."""
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(g == "wide").alias("wide"), F.col(f"{kind}_{g}").alias("found"))
                      for k, kind in enumerate(KINDS) for g in ("base", "wide")))
    rows = scanned.select("key", F.explode(parts).alias("c")).select("key", "c.kind", "c.wide", F.posexplode("c.found").alias("pos", "f")) \
        .where("f.m IS NOT NULL").select("key", "kind", "wide", "pos", "f.*").dropDuplicates(["key", "kind", "wide", "pos"])
    so_far = Window.partitionBy("key", "kind", "wide").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("m").cast("long")
    end = F.sum(F.col("gap") + size).over(so_far)
    return rows.select("key", "kind", "wide", "m", "before", "after", (end - size).alias("start"), end.alias("end"))


def _digits(m: str = "m") -> F.Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid_base() -> F.Column:
    """The check of a base span (columns kind, m)."""
    luhn = F.expr(
        "aggregate(transform(split(reverse(regexp_replace(m, '[^0-9]', '')), ''), "
        "(c, i) -> try_cast(c AS int) * (1 + i % 2) - CASE WHEN i % 2 = 1 AND c >= '5' THEN 9 ELSE 0 END), "
        "0, (s, v) -> s + coalesce(v, 0)) % 10 = 0")
    n = F.length(_digits())
    return F.when(F.col("kind") == 0, F.lit(True)) \
        .when(F.col("kind") == 1, F.col("m").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")) \
        .when(F.col("kind") == 2, F.when(n.between(16, 19), luhn).otherwise(F.lit(False))) \
        .otherwise(n.between(8, 15))


# ------------------------------------------------------------ features, trees

def features() -> list[F.Column]:
    def beside(c: F.Column) -> F.Column:
        return F.when(c.rlike("^$") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)

    n = F.length(_digits())
    return [
        F.col("kind").cast("int").alias("kind"),
        F.least(n, F.lit(20)).cast("int").alias("digits"),
        F.least(F.length(F.regexp_replace("m", "[^().:\\x20/-]", "")), F.lit(8)).cast("int").alias("parts"),
        beside(F.reverse("before")).cast("int").alias("left"), beside(F.col("after")).cast("int").alias("right"),
        F.col("before").rlike(_CUES).cast("int").alias("cue"),
        F.col("m").rlike("[+@]").cast("int").alias("mark"),
        F.least((F.char_length("m") / 4).cast("int"), F.lit(15)).alias("size"),
        F.col("m").rlike(r"\p{L}").cast("int").alias("letters")]


def weak_cue() -> F.Column:
    """Format or context that speaks for a wide candidate on its own (columns kind, m, before)."""
    n = F.length(_digits())
    return F.when(F.col("kind") == 0, F.col("m").rlike(r"[\[(]at[\])]")) \
        .when(F.col("kind") == 1, F.col("m").rlike("(?:[0-9A-Fa-f]{1,4}:){4,}")) \
        .when(F.col("kind") == 2, F.col("before").rlike(r"(?i)(?:card|visa|credit)[^0-9\n]{0,12}$") & n.between(13, 19)) \
        .otherwise(F.col("before").rlike(r"(?i)(?:tel|phone|call|fax|mobile?)[^0-9\n]{0,12}$") & n.between(7, 15))


def labelled(found: DataFrame) -> DataFrame:
    """Wide candidates with their features, weak label, and whether base spans cover them wholly.

    Base and wide spans of a text meet by sorting: base spans that overlap or adjoin form runs,
    and a candidate is covered if the run begun last before it ends no earlier."""
    own = found.withColumn("ok", F.when(F.col("wide"), F.lit(None)).otherwise(valid_base())).where("wide OR ok")
    order = Window.partitionBy("key").orderBy("start", "wide", "end", "kind")
    base_end, base_start = F.when(~F.col("wide"), F.col("end")), F.when(~F.col("wide"), F.col("start"))
    far = F.coalesce(F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    met = own.withColumn("_new", (~F.col("wide") & (far < F.col("start"))).cast("int")) \
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("_end", F.max(base_end).over(Window.partitionBy("key", "_run")))
    covered = F.coalesce("_end", F.lit(-1)) >= F.col("end")
    # the label asks for a base span of the same kind inside the candidate
    kind_down = Window.partitionBy("key", "kind").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    kind_up = Window.partitionBy("key", "kind").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_kend", F.max(base_end).over(kind_up)).withColumn("_kstart", F.min(base_start).over(kind_down))
    y = (F.coalesce("_kend", F.lit(-1)) > F.col("start")) | (F.coalesce("_kstart", F.lit(1 << 62)) < F.col("end")) | weak_cue()
    return met.select("key", "m", "start", "end", "wide", *features(), covered.alias("covered"), y.cast("int").alias("y"),
                      (F.pmod(F.xxhash64("key"), F.lit(5)) == 0).alias("held"))


def sql_score(model: Trees) -> F.Column:
    """The trees as one expression over the feature columns."""
    def grow(tree: int, node: int) -> F.Column:
        inner = model.feature.shape[1]
        if node >= inner:
            return F.lit(float(model.leaf[tree][node - inner]))
        cut = float(model.cut[tree][node])
        left = grow(tree, 2 * node + 1)
        if np.isinf(cut):
            return left
        return F.when(F.col(FEATURES[model.feature[tree][node]]) > F.lit(cut), grow(tree, 2 * node + 2)).otherwise(left)

    z = F.lit(model.base)
    for t in range(len(model.feature)):
        z = z + grow(t, 0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(wide: DataFrame) -> tuple[Trees, dict[int, float]]:
    """Trees and the threshold of each kind, from the counts per feature vector."""
    cells = wide.groupBy(*FEATURES).agg(
        F.count(F.when(~F.col("held"), 1)).alias("n"), F.coalesce(F.sum(F.when(~F.col("held"), F.col("y"))), F.lit(0)).alias("good"),
        F.count(F.when(F.col("held"), 1)).alias("held_n"), F.coalesce(F.sum(F.when(F.col("held"), F.col("y"))), F.lit(0)).alias("held_good"))
    rows = sorted(cells.collect())          # bounded by the feature grid
    x = np.array([r[: len(FEATURES)] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    n, good, held_n, held_good = (np.array([r[len(FEATURES) + i] for r in rows], np.float64) for i in range(4))
    model = fit(np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), DEPTH, ROUNDS,
                np.concatenate([good, n - good]))
    score = model.score(x)
    limits = {}
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        for cut in np.unique(score[own]):
            up = own & (score >= cut)
            total, hits = held_n[up].sum(), held_good[up].sum()
            if total:
                p, z = hits / total, 1.645
                low = (p + z * z / (2 * total) - z * np.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)
                if low >= PRECISION:
                    limits[kind] = float(cut)
                    break
    return model, limits


# ------------------------------------------------------------ spans

def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned, chosen): chosen(key, kind, start, end, base) holds base and selected spans."""
    scanned = keep(scan(docs), "scan")
    found = keep(candidates(scanned), "candidates")
    base = found.where(~F.col("wide") & valid_base()).select("key", "kind", "start", "end", F.lit(True).alias("base"))
    wide = keep(labelled(found).where("wide"), "wide")
    model, limits = train(wide)
    if not limits:
        return scanned, base
    limit = F.lit(2.0)
    for kind, cut in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(cut)).otherwise(limit)
    taken = wide.where("NOT covered").withColumn("score", sql_score(model)).where(F.col("score") >= limit - F.lit(1e-9))
    # added spans that overlap, one after the other, form an island; from the best on, each stays that overlaps none that stays
    so_far = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    island = taken.withColumn("_new", (F.coalesce(F.max("end").over(so_far), F.lit(-1)) <= F.col("start")).cast("int")) \
        .withColumn("_island", F.sum("_new").over(Window.partitionBy("key").orderBy("start", "end", "kind")))
    ranked = F.sort_array(F.collect_list(F.struct(
        "score", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), (-F.col("kind")).alias("k"),
        F.struct("kind", "start", "end").alias("s"))), asc=False)
    best = island.groupBy("key", "_island").agg(ranked.alias("r")).select("key", F.explode(F.expr(
        "aggregate(r, cast(array() AS array<struct<kind:int,start:bigint,end:bigint>>), (got, x) -> "
        "CASE WHEN exists(got, y -> y.start < x.s.end AND y.end > x.s.start) THEN got ELSE concat(got, array(x.s)) END)")).alias("s")) \
        .select("key", "s.*", F.lit(False).alias("base"))
    return scanned, base.unionByName(best.select("key", "kind", F.col("start"), F.col("end"), "base"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row."""
    scanned, chosen = spans(docs)
    per = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("s")) \
        .withColumnRenamed("key", "_key")
    name = f"element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1)"
    shown = f"array_join(transform({{}}, x -> concat({name}, ':', x.start, ':', x.end)), ',')"
    got = scanned.select("doc_id", "key").join(per, F.col("key") == F.col("_key"), "left").withColumn(
        "s", F.coalesce("s", F.expr("cast(array() AS array<struct<kind:int,start:bigint,end:bigint,base:boolean>>)")))
    return got.select(
        "doc_id", *(F.expr(f"cast(size(filter(s, x -> x.base AND x.kind = {k})) AS bigint)").alias(f"n_{kind}")
                    for k, kind in enumerate(KINDS)),
        F.sha2(F.expr(shown.format("filter(s, x -> x.base)")), 256).alias("base_sha256"),
        F.expr(shown.format("s")).alias("spans"),
        F.expr("cast(size(filter(s, x -> NOT x.base)) AS bigint)").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become
    one, named after its first. A column n_chars, where there is one, follows the new text."""
    _, chosen = spans(docs)
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    joined = chosen.select("key", "kind", "start", "end").distinct() \
        .withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int")) \
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("key", "_island").agg(F.min(F.struct("start", (-F.col("end")).alias("e"), "kind")).alias("f"), F.max("end").alias("end")) \
        .select("key", F.col("f.start").alias("start"), "end", F.col("f.kind").alias("kind"))
    last = F.lag("end", 1, 0).over(Window.partitionBy("key").orderBy("start"))
    per = joined.withColumn("last", last.cast("long")).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "last", "kind"))).alias("__cuts")).withColumnRenamed("key", "__key")
    name = f"element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1)"
    text = F.expr(
        "CASE WHEN __cuts IS NULL THEN text ELSE concat(array_join(transform(__cuts, x -> concat("
        f"substring(text, cast(x.last AS int) + 1, cast(x.start - x.last AS int)), '<', upper({name}), '>')), ''), "
        "substring(text, cast(element_at(__cuts, -1).end AS int) + 1)) END")
    fields = docs.columns
    out = docs.withColumn("__own", row_key()).join(per, F.col("__own") == F.col("__key"), "left").withColumn("text", text)
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*fields)
