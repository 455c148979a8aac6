"""Exact n-gram Jaccard join by signature trees, and the classes of documents that it links."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize, maybe_broadcast
from riskloom.llm.components import connected_components
from riskloom.llm.minhash import shingle_hashes

#: Children of a tree's node.
FAN = 8
#: Sets and shingles of a block that one task holds against another; groups of more are cut.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 19
#: A shingle is frequent if at least one of so many is that shingle; so there are at most so many frequent ones. Fewer than ``RARE`` rows are never frequent.
FREQUENT, RARE = 1 << 19, 64
#: Shingles that a task counts at once, and how often one must be among them to be told.
_CHUNK, _TOLD = 1 << 22, 4
#: Bits that a step of a traversal may look at.
_STEP_BITS = 1 << 27


# -- trees, inside a task


def token_bits(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of a set, at least one bit a shingle and a power of two: twice as wide for sets up to twice as large."""
    width = max(64, 1 << int(len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Rows:
    """Sets as rows of arrays: bitmaps of one width, sizes, shingles from the common token on, the class and cell of each, and its earlier tokens."""

    def __init__(self, at: np.ndarray, bits: np.ndarray, n: np.ndarray, rest: np.ndarray, label: np.ndarray, cell: np.ndarray, early: np.ndarray):
        order = np.lexsort((n, label))  # likely alike beside each other, so that their common parents say much
        self.at, bits, n, rest, label, cell, early = (x[order] for x in (at, bits, n, rest, label, cell, early))
        excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles beyond one a bit
        self.levels = [(bits, early, n, n, rest, excess, label, label, cell, cell)]

    def grow(self, height: int) -> None:
        """Parents of ``FAN`` nodes each: tokens of any child, earlier tokens of all, ranges of sizes, classes and cells."""
        folds = (np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
        while len(self.levels) < height:
            starts = np.arange(0, len(self.levels[-1][2]), FAN)
            self.levels.append(tuple(f.reduceat(x, starts, axis=0) for f, x in zip(folds, self.levels[-1], strict=True)))

    @property
    def height(self) -> int:
        n, h = len(self.at), 1
        while n > 1:
            n, h = -(-n // FAN), h + 1
        return h


def _may_link(a: Sequence[np.ndarray], b: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of node pairs (i, j): whether any sets below them can be linked and aren't settled yet."""
    bits_a, early_a, least_a, most_a, rest_a, excess_a, l0, l1, c0, c1 = a
    bits_b, early_b, least_b, most_b, rest_b, excess_b, m0, m1, d0, d1 = b
    needed = (least_a[i] + least_b[j]) * percent  # of (100 + percent) times the overlap
    ok = (most_a[i] * 100 >= least_b[j] * percent) & (most_b[j] * 100 >= least_a[i] * percent) & (np.minimum(rest_a[i], rest_b[j]) * (100 + percent) >= needed)
    ok &= ~((l0[i] == l1[i]) & (m0[j] == m1[j]) & (l0[i] == m0[j]))  # one class already
    ok &= ~((c0[i] == c1[i]) & (d0[j] == d1[j]) & (c0[i] == d0[j]))  # compared in one cell
    if early_a.shape[1]:
        at = np.flatnonzero(ok)
        ok[at] = ~(early_a[i[at]] & early_b[j[at]]).any(axis=1)  # all of them meet at an earlier token
    at = np.flatnonzero(ok)
    shared = np.bitwise_count(bits_a[i[at]] & bits_b[j[at]]).sum(axis=1, dtype=np.int64) + np.minimum(excess_a[i[at]], excess_b[j[at]])
    ok[at] = shared * (100 + percent) >= needed[at]
    return ok


def dual(a: Rows, b: Rows, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that may be linked, from the roots of both trees down; with ``b`` the same as ``a`` each pair once."""
    same, height = a is b, max(a.height, b.height)
    a.grow(height)
    b.grow(height)
    step = max(1, _STEP_BITS // (FAN * FAN * 64 * a.levels[0][0].shape[1]))
    down = np.arange(FAN)
    waiting = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        level, i, j = waiting.pop()
        ok = _may_link(a.levels[level], b.levels[level], i, j, percent)
        i, j = i[ok], j[ok]
        if not level:
            if same:
                i, j = i[i != j], j[i != j]
            if len(i):
                yield a.at[i], b.at[j]
            continue
        na, nb = len(a.levels[level - 1][2]), len(b.levels[level - 1][2])
        for k in range(0, len(i), step):
            x = np.broadcast_to((i[k : k + step, None] * FAN + down)[:, :, None], (len(i[k : k + step]), FAN, FAN)).ravel()
            y = np.broadcast_to((j[k : k + step, None] * FAN + down)[:, None, :], (len(j[k : k + step]), FAN, FAN)).ravel()
            there = (x < na) & (y < nb) & ((x <= y) if same else True)
            waiting.append((level - 1, x[there], y[there]))


def candidates(bits: Sequence[np.ndarray], n: np.ndarray, rest: np.ndarray, label: np.ndarray, cell: np.ndarray, early: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that may be linked. Sets of one bitmap width make a tree; of the next width, bitmaps are folded for the pairs across."""
    width = np.array([len(b) for b in bits])
    rows = {}
    for w in sorted(set(width.tolist())):
        at = np.flatnonzero(width == w)
        rows[w] = (at, np.array([bits[k] for k in at]), n[at], rest[at], label[at], cell[at], early[at])
    for w, own in rows.items():
        tree = Rows(*own)
        yield from dual(tree, tree, percent)
        if 2 * w in rows:
            at, wide, *rest = rows[2 * w]
            yield from dual(tree, Rows(at, wide[:, :w] | wide[:, w:], *rest), percent)


def linked_pairs(sets: Sequence[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Exact links between positions of different classes: enough of them that every link lies inside one class of the result."""
    root = np.unique(label, return_inverse=True)[1].astype(np.int64)
    out = []
    nothing = np.empty((len(sets), 0), np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    for i, j in candidates([token_bits(s) for s in sets], n, n, root.copy(), -1 - np.arange(len(sets)), nothing, percent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if root[a] != root[b]:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common * 100 >= (len(sets[a]) + len(sets[b]) - common) * percent:
                    out.append((a, b))
                    root[root == root[b]] = root[a]
    return out


# -- sets and prefixes of texts


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes (node, ...)`` with their texts."""
    return docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(maybe_broadcast(nodes), "node")


def _hashed(docs: DataFrame, nodes: DataFrame, words: int, out: Callable[[np.ndarray], tuple], kinds: dict[str, str]) -> DataFrame:
    """What ``out`` gives for the sets of the given ``nodes (node, d1, d2, ...)``, besides their other columns of whole numbers.

    Of rows that repeat whole a task gives one; what several tasks give is alike and does no harm.
    """
    carried = [c for c in nodes.columns if c not in ("d1", "d2")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch[~batch["node"].isin(seen) & ~batch["node"].duplicated()]
            sets = [shingle_hashes(t, words) for t in batch["text"]]
            d = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            same = (d[:, 0] == batch["d1"].to_numpy()) & (d[:, 1] == batch["d2"].to_numpy())  # an id can repeat with another text
            seen.update(batch.loc[same, "node"].tolist())
            found = [out(s) for s, k in zip(sets, same, strict=True) if k]
            yield batch.loc[same, carried].assign(**{c: [x[i] for x in found] for i, c in enumerate(kinds)})

    schema = ", ".join([*(f"{c} bigint" for c in carried), *(f"{c} {kind}" for c, kind in kinds.items())])
    return _texts(docs, nodes).mapInPandas(work, schema)


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: set size and 128-bit digest of the set (null if it is empty)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch["text"]]
            d = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets]} | {f"d{i + 1}": pd.array([x[i] for x in d], "Int64") for i in (0, 1)})

    return id_back(docs.select(id_text("doc_id"), "text").mapInPandas(work, "doc_id string, n_shingles bigint, d1 bigint, d2 bigint"), "doc_id")


def frequent_shingles(docs: DataFrame, nodes: DataFrame, words: int, limit: int = FREQUENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and about how many sets have each; at most ``limit``, as each is one of that many of all.

    They only order the shingles, so that prefixes hold rare ones: any order gives the same links. Every set is counted;
    a task tells what is frequent in its own part.
    """
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def told() -> pd.DataFrame:
            token, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pd.DataFrame({"token": token[n >= _TOLD], "n": n[n >= _TOLD]})

        size = 0
        for batch in batches:
            for text in batch["text"]:
                held.append(shingle_hashes(text, words).view(np.int64))
                size += len(held[-1])
                if size >= _CHUNK:
                    yield told()
                    size = 0
        yield told()

    least = max(rare, -(-total // limit))
    found = _texts(docs, nodes.select("node")).select("text").mapInPandas(work, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()  # at most ``limit`` rows
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found["n"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles of a set, of which a set linked to it has one among its own first: rare ones by hash, then frequent ones by their number."""
    size = len(shingles) - -(-len(shingles) * percent // 100) + 1
    token, n = frequent
    at = np.searchsorted(token, shingles)
    often = np.zeros(len(shingles), np.int64)
    inside = at < len(token)
    hit = np.flatnonzero(inside)[token[at[inside]] == shingles[inside]]
    often[hit] = n[at[hit]]
    return shingles[np.lexsort((shingles, often))[:size]]


# -- tables


def _groups(work: Callable[[pd.DataFrame], pd.DataFrame | None], key: str) -> Callable:
    """Runs ``work`` on each group of rows with one ``key``; rows come sorted by it, groups may span batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            k = batch[key].to_numpy()
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            if held and (k[0] != held[-1][key].iloc[-1]):
                cuts = np.concatenate([[0], cuts])
            if not len(cuts):
                held.append(batch)
                continue
            out = [work(pd.concat([*held, batch.iloc[: cuts[0]]]) if held else batch.iloc[: cuts[0]])]
            out += [work(batch.iloc[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            held = [batch.iloc[cuts[-1] :]]
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out)
        if held and (last := work(pd.concat(held))) is not None:
            yield last

    return run


def _links(sets: DataFrame, key: str, percent: int) -> DataFrame:
    """``(a, b)``: links within each group of ``sets (key, node, label, shingles)``, enough to join all that are linked."""

    def work(group: pd.DataFrame) -> pd.DataFrame | None:
        if len(group) < 2:
            return None
        node = group["node"].to_numpy()
        pairs = linked_pairs([s.view(np.uint64) for s in group["shingles"]], group["label"].to_numpy(), percent)
        return pd.DataFrame({"a": node[[a for a, _ in pairs]], "b": node[[b for _, b in pairs]]}) if pairs else None

    rows = sets.select(key, "node", "label", "shingles").repartition(key).sortWithinPartitions(key)
    return rows.mapInPandas(_groups(work, key), "a bigint, b bigint")


def _possible(rows: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Sets ``(unit, node)`` that may be linked to one of another class and cell in the unit, by trees of bitmaps alone; or ``(a, b)``, pairs of them that join all such pairs."""

    def work(group: pd.DataFrame) -> pd.DataFrame | None:
        if len(group) < 2:
            return None
        lists = [np.asarray(x, np.int64) for x in group["early"]]
        found, column, times = np.unique(np.concatenate([np.empty(0, np.int64), *lists]), return_inverse=True, return_counts=True)
        early = np.zeros((len(group), len(found)), bool)
        early[np.repeat(np.arange(len(group)), [len(x) for x in lists]), column] = True
        packed = np.packbits(early[:, times > 1], axis=1)
        early = np.zeros((len(group), -(-packed.shape[1] // 8) * 8), np.uint8)
        early[:, : packed.shape[1]] = packed
        bits = [np.frombuffer(b, np.uint64) for b in group["bits"]]
        n, rest, label, cell = (group[c].to_numpy(np.int64) for c in ("n", "rest", "label", "cell"))
        root, out, alive = np.arange(len(group)), [], np.zeros(len(group), bool)
        for i, j in candidates(bits, n, rest, label, cell, early.view(np.uint64), percent):
            alive[i] = alive[j] = True
            for a, b in zip(i.tolist(), j.tolist(), strict=True) if pairs else ():
                if root[a] != root[b]:
                    out.append((a, b))
                    root[root == root[b]] = root[a]
        if not alive.any():
            return None
        if not pairs:
            return group.loc[alive, ["unit", "node"]]
        node = group["node"].to_numpy()
        return pd.DataFrame({"a": node[[a for a, _ in out]], "b": node[[b for _, b in out]]})

    rows = rows.select("unit", "node", "n", "rest", "label", "cell", "bits", "early").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInPandas(_groups(work, "unit"), "a bigint, b bigint" if pairs else "unit bigint, node bigint")


def _blocks(rows, weight, block_rows: int, block_shingles: int):
    return F.greatest(F.ceil(rows / F.lit(block_rows)), F.ceil(weight / F.lit(block_shingles))).cast("bigint")


def _merged(nodes: DataFrame, links: DataFrame, label: str = "node") -> DataFrame:
    """``(node, label)`` after joining the classes that ``links (a, b)`` between nodes connect."""
    if label == "node":
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        of = lambda end: nodes.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("u"), F.col("lb").alias("v"))
    merged = connected_components(edges).select(F.col("node").alias("was"), F.col("component").alias("now"))
    out = nodes.join(maybe_broadcast(merged), F.col(label) == F.col("was"), "left")
    return materialize(out.select("node", F.coalesce("now", label).alias("label")), "labels")


def jaccard_classes(docs: DataFrame, *, words: int = 3, percent: int = 90, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, frequent: int = FREQUENT, rare: int = RARE) -> DataFrame:
    """Classes of ``docs (doc_id, text, ...)`` under the links of an exact set-similarity join.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Returns one row per input row:
    ``doc_id, n_shingles, component_id``, the smallest doc_id reachable over links.

    Rows with equal sets are one node. Sets that are linked share a token among the first ones of each, rare tokens first (``prefix``).
    Of tokens that the same sets share the first one stays, and with it the sets that have one of like size beside them. Each token's sets then make signature trees: nodes hold
    the OR of bitmaps and ranges of sizes, and pairs of nodes whose greatest overlap is too small, or all of whose sets meet at an earlier token, are left with all
    below them. Sets that may be linked form clusters; these are cut into cells of bounded size, in which trees over the full
    sets find the links. What a cell can't see, as its cluster or a token's sets are more than ``block_rows``, comes last: pairs of
    blocks of a token's sets, those of its largest class only against others, again by bitmaps and then in full. A block also holds the
    set of its group that is central, so that blocks of one group of copies grow together before. Pairs of one class are skipped, never those of two.

    Null or blank text: an empty set, linked with nothing. Null doc_id: its set is counted and it takes the component of an equal
    set, if any, else null. Repeated rows give repeated results. An id names one text: of an id that repeats with other texts
    only one is held against others. Texts of any length are read whole; extra columns are ignored; an empty table gives an empty result.
    """
    digests = materialize(set_digests(docs, words), "digests")
    usable = digests.where("n_shingles > 0 and doc_id is not null")
    nodes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"))
    nodes = materialize(nodes.dropDuplicates(["node"]), "nodes")
    ids = nodes.select("node", "d1", "d2")

    places = materialize(_places(docs, nodes, words, percent, frequent, rare, block_rows), "places")
    weight = materialize(places.groupBy("node").agg(F.sum("k").alias("weight"), F.first("n").alias("n")), "weights")
    bits = materialize(_hashed(docs, ids.join(weight.select("node"), "node"), words, lambda s: (token_bits(s).tobytes(),), {"bits": "binary"}), "bitmaps")
    alone = places.select("*", F.col("node").alias("label"), F.col("node").alias("cell"))
    pairs = materialize(_possible(_seen(_rooms(alone, weight, block_rows, block_shingles), places.where("k <= " + str(block_rows)), bits), percent, True), "possible-pairs")

    members = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "cluster")
    members = materialize(members.join(weight, "node"), "clusters")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("load"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("central"))
    sizes = sizes.select("cluster", "central", _blocks(F.col("k"), F.col("load"), block_rows, block_shingles).alias("blocks"))
    cells = materialize(members.join(sizes, "cluster").select("node", "central", "blocks", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("cell")), "cells")
    sets = materialize(_hashed(docs, ids.join(cells.select("node", "cell"), "node"), words, lambda s: (s.view(np.int64),), {"shingles": "array<bigint>"}), "sets")
    guests = materialize(cells.where("blocks > 1").select(F.col("central").alias("node"), F.col("cell").alias("other")).distinct(), "guests")
    at_home = sets.select("cell", "node", F.col("node").alias("label"), "shingles")
    away = at_home.join(maybe_broadcast(guests), "node").where("cell <> other").select(F.col("other").alias("cell"), "node", "label", "shingles")
    labels = _merged(cells.select("node"), materialize(_links(at_home.union(away), "cell", percent), "links"))

    large = places.where(f"k > {block_rows}").select("node").union(cells.where("blocks > 1").select("node")).distinct()
    if not large.isEmpty():
        labels = materialize(weight.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        known = labels.join(large, "node").join(cells.select("node", "cell"), "node", "left").select("node", "label", F.coalesce("cell", F.xxhash64("node")).alias("cell"))
        where = places.join(known, "node")
        open_ = where.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("cell").alias("c0"), F.max("cell").alias("c1")).where("l0 <> l1 and c0 <> c1")
        left = materialize(where.join(open_.select("token"), "token"), "open-places")
        alive = materialize(_possible(_seen(_units(left, block_rows, block_shingles), left, bits), percent, False), "possible")
        sets = _hashed(docs, ids.join(alive.select("node").distinct(), "node"), words, lambda s: (s.view(np.int64),), {"shingles": "array<bigint>"})
        across = _links(alive.join(labels, "node").join(sets, "node"), "unit", percent)
        labels = _merged(labels, materialize(across, "links"), "label")

    classes = nodes.join(labels.where("node <> label"), "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component"))
    joined = digests.join(classes, ["d1", "d2"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _places(docs: DataFrame, nodes: DataFrame, words: int, percent: int, frequent: int, rare: int, block_rows: int) -> DataFrame:
    """``(token, node, n, pos, k, load)``: sets at the tokens of their prefixes that they share with others of like size; ``k`` sets share the token."""
    often = frequent_shingles(docs, nodes, words, frequent, rare)
    first = _hashed(docs, nodes.select("node", "d1", "d2"), words, lambda s: (len(s), prefix(s, often, percent).view(np.int64)), {"n": "bigint", "tokens": "array<bigint>"})
    each = materialize(first, "prefixes").select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    twice = each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")  # most tokens are one set's own: they go before anything else is known of them
    each = materialize(each.join(twice, "token"), "shared-tokens")
    # Sets that share a run of tokens meet at the first of them; the same sets are told by their number and sums.
    same = [F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum("n").alias("load")]
    shared = each.groupBy("token").agg(*same, F.sum("pos").alias("at")).where("lo <> hi")
    firsts = shared.groupBy("k", "sum", "lo", "hi", "load").agg(F.min_by("token", "at").alias("token")).select("token", "k", "load")
    places = each.join(firsts, "token").select("token", "node", "n", "pos", "k", "load")
    by_size = Window.partitionBy("token").orderBy("n")
    below, above = F.lag("n").over(by_size) * 100 >= F.col("n") * percent, F.col("n") * 100 >= F.lead("n").over(by_size) * percent
    small = places.where(F.col("k") <= block_rows).withColumn("like", F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))).where("like").drop("like")
    return small.union(places.where(F.col("k") > block_rows))


def _rooms(places: DataFrame, weight: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Adds ``unit``: the token, and of large groups a block, in which the group's central set is a guest."""
    blocks = F.when(F.col("k") <= block_rows, F.lit(1).cast("bigint")).otherwise(_blocks(F.col("k"), F.col("load"), block_rows, block_shingles))
    rooms = places.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    many = rooms.where("blocks > 1").join(weight.select("node", "weight"), "node")
    guests = many.groupBy("token").agg(F.max_by(F.struct(*rooms.columns), F.struct("weight", -F.col("node"))).alias("g")).select("g.*")
    guests = guests.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("other <> block").withColumn("block", F.col("other")).drop("other")
    return rooms.unionByName(guests).withColumn("unit", F.xxhash64("token", "block"))


def _seen(units: DataFrame, met: DataFrame, bits: DataFrame) -> DataFrame:
    """``units`` with each set's bitmap, its shingles from the token on (``rest``) and the earlier tokens of it in ``met``, where its pairs have been."""
    before = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("before"))  # of one set's own prefix
    rows = units.join(before, "node", "left").join(bits, "node")
    early = F.transform(F.filter(F.coalesce("before", F.array()), lambda x: x["pos"] < F.col("pos")), lambda x: x["token"])
    return rows.withColumn("early", early).withColumn("rest", F.col("n") - F.col("pos"))


def _units(left: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Adds ``unit``: rows of a token that one task holds against each other. Small groups are one unit; large ones are pairs of blocks, of which one is outside the largest class."""
    per = left.groupBy("token", "label").agg(F.count("*").alias("k"), F.sum("n").alias("load"))
    groups = per.groupBy("token").agg(F.sum("k").alias("k"), F.sum("load").alias("load"), F.max_by(F.struct("label", "k", "load"), F.struct("k", "label")).alias("m"))
    rest = _blocks(F.col("k") - F.col("m.k"), F.col("load") - F.col("m.load"), block_rows, block_shingles)
    sized = groups.select("token", F.col("m.label").alias("main"), _blocks(F.col("k"), F.col("load"), block_rows, block_shingles).alias("all"), _blocks(F.col("m.k"), F.col("m.load"), block_rows, block_shingles).alias("mains"), rest.alias("others"))
    rows = left.join(sized, "token")
    number = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    block = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("others")))
    rows = rows.withColumn("b", block)
    with_mains = F.transform(number("mains"), lambda m: F.xxhash64("token", F.lit("main"), m, F.col("b")))
    with_others = F.transform(number("others"), lambda o: F.xxhash64("token", F.lit("rest"), F.least(o, "b"), F.greatest(o, "b")))
    with_rest = F.transform(number("others"), lambda o: F.xxhash64("token", F.lit("main"), F.col("b"), o))
    unit = F.when(F.col("all") <= 2, F.array(F.xxhash64("token"))).when(F.col("label") == F.col("main"), with_rest).otherwise(F.concat(with_mains, with_others))
    return rows.select("node", "token", "pos", "n", "label", "cell", F.explode(unit).alias("unit"))


#: The query over three-word shingles, by comparing all pairs that share one.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in generate_series(1, len(w) - 2)] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) + any_value(b.n) AS total FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (total - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
