"""SimHash near-duplicates by vantage-point trees (operator 10).

* ``fingerprints``: 64-bit SimHash per text, computed in Arrow batches.
* ``links``: distinct fingerprints at most ``max_bits`` apart. A tree of
  vantage points (built from a bounded, hash-chosen sample: it only steers the
  partitioning) cuts the Hamming space. Points with distance <= mu + max_bits
  go inside, those with distance > mu outside, so by the triangle inequality
  any two points within ``max_bits`` meet in at least one shard: the band
  (mu, mu + max_bits] is stored on both sides. Inside a shard the same split
  goes on until a leaf is small enough to compare whole blocks. A shard emits a
  spanning forest of its links, never all pairs of a dense group.
* ``components``: min-label stars over the forest edges (alternating large and
  small stars), each round written to the shared folder.

Defined results: null or blank text has fingerprint zero; texts with fewer words
than a shingle use the whole sequence; repeated rows share a component; null ids
stay in the result but never name a component; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import keep, mix, text_bytes

LEAF_POINTS = 2000      # wanted points of a shard
MAX_SHARDS = 4096       # bound of the broadcast tree; larger shards split further inside their task
SAMPLE = 16384          # bounded sample that places the vantage points
LOCAL_LEAF = 768
NEIGHBOURS = 1 << 23           # one-bit neighbours met at once


# ------------------------------------------------------------ fingerprints

def simhash(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()     # bytes: only A-Z change, only [\x20\x09-\x0D] split
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        parts = zip(*(words[a + k: b + k] for k in range(shingle)))
        hs = np.fromiter((digest(s, 42) for s in map(join, parts)), np.uint64, b - a)
        counts += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint's bits as a signed long."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            raw = data.tobytes()
            fp = np.fromiter((simhash(raw[a:b], shingle) for a, b in zip(offs[:-1], offs[1:])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------ vantage-point tree

def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage point, radius): of a few candidates the one whose distances spread most."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = _distance(points, int(v))
        mu = int(np.median(d))
        if d.max() > mu and (best is None or d.std() > best[0]):
            best = (d.std(), int(v), mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, inside, outside); a negative child -k-1 is shard k."""
    nodes: list[list[int]] = []
    shards = 0
    rng = np.random.default_rng(seed)

    def grow(points: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _split(points, rng) if left and len(points) > 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append([cut[0], cut[1], 0, 0])
        d = _distance(points, cut[0])
        nodes[at][2] = grow(points[d <= cut[1]], left - 1)
        nodes[at][3] = grow(points[d > cut[1]], left - 1)
        return at

    grow(sample, depth)
    return [tuple(n) for n in nodes]


def assign(points: np.ndarray, tree: list[tuple[int, int, int, int]], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard): every shard a point may share with a partner."""
    if not tree:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    idx, shard = [], []
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            idx.append(own)
            shard.append(np.full(len(own), -node - 1))
            continue
        vantage, mu, inside, outside = tree[node]
        d = _distance(points[own], vantage)
        todo += [(inside, own[d <= mu + max_bits]), (outside, own[d > mu])]
    return np.concatenate(idx or [np.zeros(0, np.int64)]), np.concatenate(shard or [np.zeros(0, np.int64)])


def _roots(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Min labels after joining the pairs (a, b); labels point at their root's index."""
    while True:
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            return lab
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _neighbour_labels(points: np.ndarray) -> np.ndarray:
    """Min labels after joining all points at most two bits apart, linear in their number: two
    such points share one of the 65 values that each can become by at most one bit, and points
    that share one are at most two bits apart. Values are met in slices of bounded size."""
    n = len(points)
    lab, at = np.arange(n), np.arange(n)
    slices = max(1, -(-65 * n // NEIGHBOURS))
    for part in range(slices):
        values, owners = [], []
        for bit in range(-1, 64):
            value = points if bit < 0 else points ^ np.uint64(1 << bit)
            own = at if slices == 1 else np.flatnonzero(mix(value) % np.uint64(slices) == np.uint64(part))
            values.append(value[own])
            owners.append(own)
        value, owner = np.concatenate(values), np.concatenate(owners)
        by = np.argsort(value, kind="stable")
        same = np.flatnonzero(value[by[1:]] == value[by[:-1]])
        lab = _roots(n, owner[by[same]], owner[by[same + 1]], lab)
    return lab


def forest(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links among distinct ``points``."""
    rng = np.random.default_rng(11)
    out_a, out_b = [], []
    todo = [np.sort(points)]
    while todo:
        own = todo.pop()
        n = len(own)
        if n < 2:
            continue
        cut = _split(own, rng) if n > LOCAL_LEAF else None
        if cut is not None:
            d = _distance(own, cut[0])
            inside, outside = own[d <= cut[1] + max_bits], own[d > cut[1]]
            if len(inside) < 0.85 * n:
                todo += [inside, outside]
                continue
        lab = np.arange(n)
        rows = max(1, (1 << 21) // n)
        dense = max_bits == 2 and n > LOCAL_LEAF            # no vantage point parts them: all lie close together
        if dense:
            lab = _neighbour_labels(own)
        for s in range(0, 0 if dense else n, rows):
            near = np.bitwise_count(own[s: s + rows, None] ^ own[None, s:]) <= max_bits
            i, j = np.nonzero(near)
            keep_ = i < j
            lab = _roots(n, i[keep_] + s, j[keep_] + s, lab)
        child = np.flatnonzero(lab != np.arange(n))
        out_a.append(own[child])
        out_b.append(own[lab[child]])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(out_a or empty), np.concatenate(out_b or empty)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Forest edges (a, b) among the distinct fingerprints in ``fps(fp)``."""
    spark = fps.sparkSession
    n = fps.count()
    depth = int(np.ceil(np.log2(min(MAX_SHARDS, max(1, n / LEAF_POINTS))))) if n else 0
    picked = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if depth else []
    tree = build_tree(np.array([r.fp for r in picked], np.int64).view(np.uint64), depth) if depth else []

    def place(batches):
        for batch in batches:
            points = batch.column(0).to_numpy()
            i, shard = assign(points.view(np.uint64), tree, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(points[i])], ["shard", "fp"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    if not n:
        return spark.createDataFrame([], "a long, b long")
    placed = fps.select("fp").mapInArrow(place, "shard int, fp long")
    return placed.groupBy("shard").applyInPandas(join, "a long, b long")


# ------------------------------------------------------------ components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node.

    Alternating stars: minima are partial aggregates, and edges meet them by a
    join of two written tables, which Spark splits where a hub is hot.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "low")
        met = both.join(low, "a")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            met.select("a", F.col("m").alias("b")))

    def print_of(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).head()
        return r.n, r.s

    edges = keep(edges.where("a <> b").distinct(), "edges")
    seen = print_of(edges)
    while seen[0]:
        edges = keep(star(star(edges, True), False).where("a <> b").distinct(), "edges")
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    fp = keep(fingerprints(docs, shingle), "fingerprints")
    least = keep(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    comp = keep(components(links(least.select("fp"), max_bits)), "components")
    member = comp.join(least, comp.node == least.fp).select("node", "root", "least_id")
    named = keep(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    known = keep(least.join(comp.join(named, "root"), F.col("fp") == F.col("node"), "left").select(
        F.col("fp"), F.coalesce("component_id", "least_id").alias("component_id")), "known")
    return fp.join(known, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one of the least doc_id; of several rows
    of that id the one with the least key, of equal rows one. Rows without an id come last, so one
    of them stays only if its component has no id at all."""
    keys = [F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("__k1"),
            F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id").cast("long")).alias("__k2")]

    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(3))
            raw = data.tobytes()
            fp = np.fromiter((simhash(raw[a:b], shingle) for a, b in zip(offs[:-1], offs[1:])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "__k1", "__k2", "fp"])

    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "text").mapInArrow(
        run, "doc_id long, __k1 long, __k2 long, fp long"), "fingerprints")
    comp = keep(components(links(rows.select("fp").distinct(), max_bits)), "components")
    named = rows.join(comp, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("__k1"), F.col("__k2")))
    stays = keep(named.groupBy("root").agg(first.alias("f")).select("f.__k1", "f.__k2"), "stays")
    kept = docs.select("*", *keys).join(stays, ["__k1", "__k2"], "left_semi")
    twins = keep(rows.groupBy("__k1", "__k2").count().where("count > 1").join(
        stays, ["__k1", "__k2"], "left_semi").select("__k1", "__k2"), "twins")
    if not twins.isEmpty():                             # equal rows: only these are brought together
        kept = kept.join(twins, ["__k1", "__k2"], "left_anti").unionByName(
            kept.join(twins, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]))
    return kept.select(*docs.columns)
