import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import signature_trees as trees
from riskloom.llm.minhash import shingle_hashes
from riskloom.llm.signature_trees import jaccard_classes

from .helpers import DOCS, docs, prose
from .test_minhash import brute, edited


def classes(spark, rows, **options):
    return {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_classes(docs(spark, rows), **options).collect()}


def expected(rows, words=3, percent=90):
    return {i: x[:2] for i, x in brute(rows, words, percent).items()}


def mixed_rows():
    r = random.Random(7)
    base = [prose(k, n) for k, n in enumerate([60, 90, 240, 31])]
    rows = [(i, edited(r, base[i % 4], r.choice([0, 1, 1, 2, 2, 3, 4, 6]))) for i in range(200)]
    shared = prose(77, 50)
    rows += [(300 + i, f"{prose(400 + i // 2, 30)} {shared} {prose(900 + i, i % 3)}") for i in range(60)]
    rows += [(500 + i, prose(100 + i, r.randint(1, 60))) for i in range(20)]
    return rows + [(600, "One"), (601, "one"), (602, "one two"), (603, " ONE\ttwo\n"), (604, ""), (605, " \n"), (606, None), (607, "Äb c"), (608, "äb c"), (609, "a a a a"), (610, "a A a")]


@pytest.mark.parametrize("options", [{}, {"block_rows": 8, "rare": 4}, {"block_shingles": 300, "rare": 1000}, {"words": 2, "percent": 80, "block_rows": 16}])
def test_against_all_pairs(spark, options):
    """Cells and units of one block and of many, frequent shingles in order and not: the classes of brute force."""
    rows = mixed_rows()
    assert classes(spark, rows, **options) == expected(rows, options.get("words", 3), options.get("percent", 90))


def test_chain_over_cells(spark):
    """A chain in which only neighbours are linked is one class, though its ends share little and cells are tiny."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(120)]
    assert classes(spark, rows, block_rows=4) == expected(rows)
    assert {c for _, c in classes(spark, rows, block_rows=4).values()} == {0}


def test_candidates_hold_all_links():
    """Trees of every height leave no linked pair out, and few others."""
    r = random.Random(3)
    sets = [shingle_hashes(edited(r, prose(k % 9, r.choice([20, 90, 95, 300])), r.randrange(4)), 3) for k in range(300)]
    none = np.empty((300, 0), np.uint64)
    unlike = np.arange(300)
    found = set()
    n = np.array([len(s) for s in sets])
    for i, j in trees.candidates([trees.token_bits(s) for s in sets], n, n, unlike, unlike, none, 90):
        pairs = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert not pairs & found and all(a != b for a, b in pairs)
        found |= pairs
    linked = {(a, b) for a in range(300) for b in range(a) if 190 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 90 * (len(sets[a]) + len(sets[b])) and c}
    linked = {tuple(sorted(p)) for p in linked}
    assert linked and linked <= found and len(found) < 2 * len(linked) + 50


def test_pairs_meet_once():
    """A pair that shares an earlier token isn't looked at again; one class and one cell aren't either."""
    s = [shingle_hashes(prose(1, 60), 3)] * 4
    bits, n, own = [trees.token_bits(x) for x in s], np.array([len(x) for x in s]), np.arange(4)
    pairs = lambda label, cell, early: sorted(tuple(sorted(p)) for i, j in trees.candidates(bits, n, n, label, cell, early, 90) for p in zip(i.tolist(), j.tolist(), strict=True))
    none = np.empty((4, 0), np.uint64)
    assert pairs(own, own, none) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert pairs(np.array([0, 0, 1, 1]), own, none) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert pairs(own, np.array([5, 5, 5, 6]), none) == [(0, 3), (1, 3), (2, 3)]
    assert pairs(own, own, np.array([[1], [3], [2], [0]], np.uint64)) == [(0, 2), (0, 3), (1, 3), (2, 3)]


def test_prefixes_of_linked_sets_meet():
    r = random.Random(5)
    often = np.sort(shingle_hashes(prose(1, 40), 3)[::2])
    for k in range(200):
        a = shingle_hashes(prose(1, 40 + k), 3)
        b = np.array(sorted(set(a.tolist()) - set(r.sample(a.tolist(), len(a) // 10))), np.uint64)
        pa, pb = (trees.prefix(x, (often, np.arange(len(often)) + 5), 90) for x in (a, b))
        assert 10 * len(b) < 9 * len(a) or len(np.intersect1d(pa, pb))


def test_groups_span_batches():
    import pandas as pd

    r = random.Random(2)
    keys = sorted(r.choice([1, 2, 2, 2, 3, 5, 8]) for _ in range(60)) + [9]
    for step in (1, 2, 7, 100):
        batches = [pd.DataFrame({"key": keys[i : i + step]}) for i in range(0, len(keys), step)] + [pd.DataFrame({"key": []})]
        sums = pd.concat(list(trees._groups(lambda g: pd.DataFrame({"key": g["key"][:1], "n": [len(g)]}), "key")(iter(batches))))
        assert {int(k): n for k, n in zip(sums["key"], sums["n"], strict=True)} == {k: keys.count(k) for k in keys} and len(sums) == len(set(keys))
    assert list(trees._groups(lambda g: g, "key")(iter([]))) == []


def test_nulls_repeats_and_empty(spark):
    rows = [(None, prose(1, 40)), (3, prose(1, 40)), (3, prose(1, 40)), (None, "alone here now"), (9, None), (12, "a b"), (12, prose(1, 40))]
    got = sorted(((repr(x["doc_id"]), x["n_shingles"], x["component_id"]) for x in jaccard_classes(docs(spark, rows)).collect()), key=repr)
    n = len(shingle_hashes(prose(1, 40), 3))
    assert [g for g in got if g[0] != "12"] == [("3", n, 3), ("3", n, 3), ("9", 0, 9), ("None", 1, None), ("None", n, 3)]
    assert jaccard_classes(spark.createDataFrame([], DOCS)).collect() == []


def test_long_texts(spark):
    rows = [(1, prose(5, 30_000)), (2, prose(5, 30_000) + " tail"), (3, prose(6, 30_000)), (4, "x" * 300_000), (5, "X" * 300_000)]
    assert {i: c for i, (_, c) in classes(spark, rows).items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
