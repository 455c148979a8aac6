"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize, maybe_broadcast
from riskloom.llm.components import connected_components

#: A pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Of the packed bits (one of each minimum) a pair at 0.8 differs in 16 of 160 on average (deviation 3.8).
MAX_BITS_APART = 36
#: Groups of more comparisons than this are cut by their rarest shingles first.
DIRECT_PAIRS = 4_000_000
SEED = 20240607
_STEP = 1024

_SIGNATURE = "doc_id string, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, s1 bigint, s2 bigint, s3 bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; of the whole sequence if it has fewer words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


class Hasher:
    """Multiply-and-add minima over 64 bits, drawn once from a seed; alike on every executor."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        draw = np.random.default_rng(seed).integers(0, 2**64, (3, bands * rows), np.uint64)
        self.a, self.b = (draw[0] | np.uint64(1))[:, None], draw[1][:, None]
        self.weights = (draw[2] | np.uint64(1)).reshape(bands, rows)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64)
        self.bands, self.rows = bands, rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        parts = [(self.a * shingles[i : i + _STEP] + self.b).min(axis=1) for i in range(0, len(shingles), _STEP)]
        return parts[0] if len(parts) == 1 else np.min(parts, axis=0)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        mixed = _mix(minima).reshape(self.bands, self.rows)
        return _mix((mixed * self.weights).sum(axis=1, dtype=np.uint64) + self.salt)

    def bits(self, minima: np.ndarray) -> np.ndarray:
        packed = np.packbits((_mix(minima) & np.uint64(1)).astype(np.uint8))
        return np.frombuffer(packed.tobytes().ljust(24, b"\0"), np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: set size, 128-bit digest of the set, band keys and packed signature bits."""
    if bands * rows > 192:
        raise ValueError("at most 192 minima fit the packed signature")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bands, rows)
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_hashes(text, words)
                if not len(s):
                    out.append((0, None, None, None, None, None, None))
                    continue
                m = hasher.minima(s)
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                out.append((len(s), d[0], d[1], hasher.keys(m).view(np.int64), *hasher.bits(m)))
            frame = pd.DataFrame({"doc_id": batch["doc_id"]})
            for c, values in zip(("n_shingles", "d1", "d2", "bands", "s1", "s2", "s3"), zip(*out, strict=True), strict=True):
                frame[c] = list(values) if c == "bands" else pd.array([None if v is None else int(v) for v in values], "Int64")  # never by way of floats
            yield frame

    return id_back(docs.select(id_text("doc_id"), "text").mapInPandas(work, _SIGNATURE), "doc_id")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)``, the full sets of the given nodes ``(node, d1, d2)``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch["text"]]
            d = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            same = (d[:, 0] == batch["d1"].to_numpy()) & (d[:, 1] == batch["d2"].to_numpy())
            yield pd.DataFrame({"node": batch["node"], "shingles": [s.view(np.int64) for s in sets]})[same]

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text")
    return texts.join(maybe_broadcast(nodes), "node").mapInPandas(work, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _close(a: str, b: str, percent: int, most: int):
    """Necessary for a link: set sizes within the ratio, signatures not too far apart."""
    apart = sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in (1, 2, 3))
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart <= most), apart


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs (a, b)`` with a boolean ``linked``: the exact similarity of the full sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.select("a", "b", (F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).alias("linked"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, max_bits_apart: int = MAX_BITS_APART, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """Groups of near copies among ``docs (doc_id, text, ...)``.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``. Two documents are linked if
    100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the smallest doc_id
    reachable over links, ``kept`` holds for that document.

    Rows with equal sets are one node; nodes that share a band key are candidates. First each is held against two
    hubs of its buckets, the most central one and the one with the closest signature. Buckets that still hold
    nodes of different components then go to ``_rest``, which finds all links across them. Every link is
    checked on the full sets.

    Null or blank text: an empty set, linked with nothing. Null doc_id: its set is counted and it takes the
    component of an equal set, if any (then it isn't kept), else null (then it is kept). Repeated rows give
    repeated results. An id names one text: of an id that repeats with other texts only one is held against others, so
    give rows a number of their own where that happens, as the pipeline's stage does. Extra columns are ignored. Texts of any
    length are read whole. An empty table gives an empty result.
    """
    sig = materialize(signatures(docs, words, bands, rows), "signatures")
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "s1", "s2", "s3")]
    nodes = materialize(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), *firsts), "nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(keys.join(shared, "key"), "members")
    central = materialize(members.groupBy("node").agg(F.sum("size").alias("weight")), "central")  # copies with few changes share the most
    hubs = members.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    candidates = materialize(central.join(nodes.drop("bands"), "node"), "candidates")
    sets = materialize(_sets(docs, candidates.select("node", "d1", "d2"), words), "sets")

    light = candidates.select("node", "weight", "n_shingles", "s1", "s2", "s3")
    near, apart = _close("x", "y", percent, max_bits_apart)
    spokes = members.join(hubs, "key").where("node <> hub").select("hub", "node").distinct().alias("p")
    spokes = spokes.join(light.alias("x"), F.col("p.hub") == F.col("x.node")).join(light.alias("y"), F.col("p.node") == F.col("y.node")).where(near)
    spokes = spokes.select(F.col("p.hub").alias("a"), F.col("p.node").alias("b"), F.col("x.weight").alias("weight"), apart.alias("apart"))
    best = spokes.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("a1"), F.min_by("a", F.struct("apart", "a")).alias("a2"))
    linked = _linked(best.select(F.explode(F.array_distinct(F.array("a1", "a2"))).alias("a"), "b"), sets, percent)
    labels = _relabel(light.select("node", F.col("node").alias("component")), materialize(linked, "links"))
    labels = _relabel(labels, materialize(_rest(members, central, labels, sets, percent, direct_pairs), "links"))

    classes = nodes.select("d1", "d2", "node").join(labels.where("node <> component"), "node", "left")
    classes = classes.select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    joined = sig.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _rest(members: DataFrame, central: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, direct_pairs: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of different components that share a bucket; none is left out.

    A bucket is handled relative to one hub, the most central node of its largest component. Of each node a bitmap
    tells which shingles of the hub it has; ``common`` counts its other shingles that any other node of the hub's
    group has too. Two nodes have at most as many shingles in common as their bitmaps plus the lesser count.
    That bound settles nearly all pairs inside the join, between nodes outside the hub's component and all nodes
    of the group; only pairs that pass it leave the join, to be checked on the full sets. Groups of more than ``direct_pairs``
    such comparisons go by shared rare shingles instead (``_by_rare_shingles``), so their work isn't that of all pairs.
    """
    labelled = members.select("key", "node").join(labels, "node")
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main")).where("parts > 1").select("key", "main")
    mains = maybe_broadcast(materialize(main, "mixed-buckets"))
    medoid = labels.join(central, "node").groupBy(F.col("component").alias("main")).agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    medoid = maybe_broadcast(materialize(medoid.join(mains.select("main").distinct(), "main", "left_semi"), "medoids"))
    group = materialize(labelled.join(mains, "key").join(medoid, "main").select("hub", "main", "node", "component").distinct(), "groups")
    hub_sets = sets.join(group.select(F.col("hub").alias("node")).distinct(), "node").select(F.col("node").alias("hub"), F.col("shingles").alias("hub_set"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits, extra = [], []
            for h, s in zip(batch["hub_set"], batch["shingles"], strict=True):
                packed = np.packbits(np.isin(h, s, assume_unique=True))
                bits.append(np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), np.int64))
                extra.append(np.setdiff1d(s, h, assume_unique=True))
            yield batch[["hub", "main", "node", "component"]].assign(n=[len(s) for s in batch["shingles"]], n_hub=[len(h) for h in batch["hub_set"]], bits=bits, extra=extra)

    both = group.join(hub_sets, "hub").join(sets, "node").select("hub", "main", "node", "component", "hub_set", "shingles")
    coded = materialize(both.mapInPandas(encode, "hub bigint, main bigint, node bigint, component bigint, n bigint, n_hub bigint, bits array<bigint>, extra array<bigint>"), "coded")
    inside = coded.where("component <> main").select(F.col("hub").alias("a"), F.col("node").alias("b"), ((F.col("n") - F.size("extra")) * 100 >= (F.col("n_hub") + F.size("extra")) * percent).alias("linked"))

    extras = coded.select("hub", "node", F.explode("extra").alias("x"))
    twice = extras.groupBy("hub", "x").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    common = extras.join(twice, ["hub", "x"]).groupBy("hub", "node").agg(F.count("*").alias("common"))
    rows = coded.drop("extra", "n_hub").join(common, ["hub", "node"], "left").fillna(0, ["common"])
    load = rows.groupBy("hub").agg((F.count("*") * F.count_if(F.col("component") != F.col("main")) / F.lit(max(direct_pairs, 1))).cast("bigint").alias("more"))
    rows = materialize(rows.join(load.where("more > 0" if direct_pairs else "more >= 0").select("hub", F.lit(True).alias("large")), "hub", "left"), "coded")
    small = rows.where("large is null")
    l, r = small.where("component <> main").alias("l"), small.alias("r")
    once = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")))
    pairs = l.join(r, (F.col("l.hub") == F.col("r.hub")) & once & _may_link(percent)).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    large = rows.where("large")
    if not large.isEmpty():
        pairs = pairs.union(_by_rare_shingles(large, sets, percent, max(direct_pairs, 1)))
    return _linked(pairs.distinct(), sets, percent).union(inside)


def _may_link(percent: int):
    """Necessary for a link of coded rows ``l`` and ``r`` of one group: the sizes, and the most shingles they can have in common."""
    shared = F.aggregate(F.zip_with("l.bits", "r.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, x: a + x)
    most = shared + F.least("l.common", "r.common")
    sized = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent
    return sized & (most * (100 + percent) >= (F.col("l.n") + F.col("r.n")) * percent)


def _by_rare_shingles(rows: DataFrame, sets: DataFrame, percent: int, direct_pairs: int) -> DataFrame:
    """Pairs ``(a, b)`` of coded rows of different components that may be linked, by a prefix filter within each hub's group.

    Shingles are ordered by how many nodes of the group have them, the rarest first. Two sets at the similarity share one of
    the first n - ceil(n * similarity) + 1 shingles of each, and after the first they share at most the rest of the shorter
    one. Only shingles of several components join, and of those the nodes outside a shingle's largest component are
    held against all; groups of a shingle are split by a salt, so that no task holds more than ``direct_pairs`` comparisons.
    """
    each = rows.select("hub", "node", "component").join(sets, "node").select("hub", "node", "component", F.explode("shingles").alias("x"))
    per = each.groupBy("hub", "x").agg(F.count("*").alias("f"), (F.min("component") != F.max("component")).alias("mixed"))
    ordered = each.join(per, ["hub", "x"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("f", "x", "mixed"))).alias("o"))
    n = F.size("o")
    first = n - F.ceil(n * percent / F.lit(100.0)).cast("int") + 1
    prefix = ordered.select("hub", "node", F.posexplode(F.slice("o", F.lit(1), first)).alias("pos", "t")).where("t.mixed").select("hub", "node", "pos", "t.x")
    coded = materialize(prefix.join(rows.select("hub", "node", "component", "n", "bits", "common"), ["hub", "node"]), "rare-shingles")
    sizes = coded.groupBy("hub", "x", "component").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("hub", "x").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("component", F.struct("k", -F.col("component"))).alias("main"), F.count("*").alias("parts"))
    groups = groups.where("parts > 1").select("hub", "x", "main", (F.col("k") * (F.col("k") - F.col("most")) / F.lit(direct_pairs)).cast("bigint").alias("more"))
    coded = coded.join(groups, ["hub", "x"])
    l = coded.where("component <> main").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("more") + 1)).alias("l")
    r = coded.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more")))).alias("r")
    once = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")))
    after = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) * (100 + percent) >= (F.col("l.n") + F.col("r.n")) * percent
    near = l.join(r, (F.col("l.hub") == F.col("r.hub")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.salt") == F.col("r.salt")) & once & after & _may_link(percent))
    return near.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))


def _relabel(labels: DataFrame, tried: DataFrame) -> DataFrame:
    """``labels (node, component)`` after merging components over those of ``tried (a, b, linked)`` that are linked."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    edges = tried.where("linked").join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
    merged = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = labels.join(maybe_broadcast(merged), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return materialize(out, "labels")


#: The query over two-word shingles, by comparing all pairs that share one.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) + any_value(b.n) AS total FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (total - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
