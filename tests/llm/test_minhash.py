import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.llm.minhash import _by_rare_shingles, near_duplicates

from .helpers import DOCS, docs, prose


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(words, len(w)) or 1
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("words", "direct"), [(2, 4_000_000), (2, 0), (5, 4_000_000), (5, 0), (2, 200)])
def test_against_all_pairs(spark, words, direct):
    """Large groups go by rare shingles, here all of them or some: the same links."""
    r = random.Random(words)
    base = [prose(k, 90) for k in range(4)]
    rows = [(i, edited(r, base[i % 4], r.choice([0, 1, 2, 3, 4, 5, 6, 9, 12]))) for i in range(160)]
    rows += [(500 + i, prose(100 + i, r.randint(1, 60))) for i in range(20)]
    rows += [(600, "One"), (601, "one"), (602, "one two"), (603, " ONE\ttwo\n"), (604, ""), (605, " \n"), (606, None), (607, "Äb c"), (608, "äb c")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(docs(spark, rows), words=words, direct_pairs=direct).collect()}
    assert got == brute(rows, words)


@pytest.mark.parametrize("direct", [4_000_000, 0])
def test_boilerplate_with_own_parts(spark, direct):
    """Nine of ten documents share most of their text, and pairs of them a part of their own: many components in one bucket."""
    shared = prose(1, 80)
    rows = [(i, f"{shared} {prose(1000 + i // 2, 12 + i % 3)} {prose(5000 + i, i % 4)}") for i in range(180)] + [(500 + i, prose(9000 + i, 40)) for i in range(20)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(docs(spark, rows), words=2, direct_pairs=direct).collect()}
    assert got == brute(rows, 2)


def test_work_of_a_mixed_group(spark):
    """2,000 documents of one template with own parts of a third: few pairs share a rare shingle, so few are held against each other."""
    shared = prose(1, 60)
    rows = [(i, f"{shared} {' '.join(f'own{i // 2}x{k}' for k in range(40 + i % 2))}") for i in range(2000)]
    coded = spark.createDataFrame([("h", i, i // 2, t) for i, t in rows], "hub string, node bigint, component bigint, text string")
    coded = coded.select("hub", "node", F.col("node").alias("component"), F.array_distinct(F.transform(F.split("text", " "), lambda w: F.xxhash64(w))).alias("shingles"))
    sets = coded.select("node", "shingles")
    bits = coded.select("hub", "node", "component", F.size("shingles").cast("bigint").alias("n"), F.array(F.lit(-1).cast("bigint")).alias("bits"), F.lit(10**6).cast("bigint").alias("common"))
    pairs = _by_rare_shingles(bits, sets, 80, 4_000_000).distinct()
    found = {(x["a"], x["b"]) for x in pairs.collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(1000)}  # of two million pairs


def test_nulls_repeats_and_empty(spark):
    rows = [(None, prose(1, 40)), (3, prose(1, 40)), (3, prose(1, 40)), (None, "alone here now"), (9, None)]
    got = sorted(((repr(x["doc_id"]), x["component_id"], x["kept"]) for x in near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == [("3", 3, True), ("3", 3, True), ("9", 9, True), ("None", 3, False), ("None", None, True)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_long_text(spark):
    rows = [(1, prose(5, 30_000)), (2, prose(5, 30_000) + " tail")]
    assert {x["component_id"] for x in near_duplicates(docs(spark, rows)).collect()} == {1}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    edges = spark.createDataFrame([*pairs, (None, 3)], "u bigint, v bigint")
    got = {x["node"]: x["component"] for x in connected_components(edges).collect()}
    assert got == {i: find(i) for i in root}
    assert connected_components(edges.where(F.lit(False))).collect() == []
