"""Importance resampling against a plain version that builds every n-gram; the algebra of CRCs; ties and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import importance
from riskloom.llm.importance import Shifts, gram_crcs, resample, word_bytes

from .helpers import DOCS, docs, prose


def grams_of(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + g]) for g in range(1, most + 1) for i in range(len(words) - g + 1)]


def plain(rows, target, most=1, buckets=10_000, min_words=20, percent=10, salt=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in grams_of(text, most)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        words, features = grams_of(text, most)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def got(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


ODD = [(9001, None), (9002, ""), (9003, " \n…!"), (9004, "Ünïcode ÜBER straße, x2-y_z " * 30), (9005, "a" * 200_000 + " b" * 30), (9006, "ONE two,three"), (-7, prose(3, 40))]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 50), (2, 7, 100)])
def test_against_a_plain_version(spark, most, buckets, percent):
    rows = [(i, prose(i % 60, 5 + i % 50)) for i in range(200)] + ODD
    target = [prose(i, 30) for i in range(500, 510)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    out = resample(docs(spark, rows).repartition(5), bench, grams=most, buckets=buckets, percent=percent)
    expected = plain(rows, target, most, buckets, percent=percent)
    assert got(out) == expected
    drawn = sum(x[4] is not None for x in expected)
    assert drawn > 10 and sorted(x[4] for x in got(out) if x[4]) == list(range(1, drawn + 1))


def test_ties_repeats_and_nulls(spark):
    """Rows of one id and text have one score and ranks of their own; without an id a row comes last among equals."""
    text = prose(1, 30)
    rows = [(5, text)] * 6 + [(None, text)] * 4 + [(i, text) for i in range(10, 30)]
    out = got(resample(docs(spark, rows), spark.createDataFrame([(prose(2, 20),)], "text string"), percent=100))
    assert sorted(x[4] for x in out) == list(range(1, 31))
    assert {x[:4] for x in out} == {x[:4] for x in plain(rows, [prose(2, 20)], percent=100)}
    by_rank = sorted(out, key=lambda x: x[4])
    assert [x[3] for x in by_rank] == sorted((x[3] for x in out), reverse=True)


def test_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(spark.createDataFrame([], DOCS), none).collect() == []
    rows = [(i, prose(i, 25)) for i in range(20)] + [(99, None)]
    assert got(resample(docs(spark, rows), none)) == plain(rows, [])


def test_crcs_without_strings():
    """Runs of up to six words, of any length and of none, by matrices alone."""
    r = random.Random(3)
    for _ in range(30):
        words = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 1, 2, 5, 30, 300, 5000]))) for _ in range(r.randint(0, 12))]
        expected = [zlib.crc32(b" ".join(words[i : i + g])) for g in range(1, 7) for i in range(len(words) - g + 1)]
        assert gram_crcs(words, 6, Shifts()).tolist() == expected


def test_shift_is_a_group():
    s = Shifts()
    crcs = np.array([random.Random(k).getrandbits(32) for k in range(50)], np.uint32)
    zero = np.zeros(50, np.uint32)
    move = lambda x, n: s.join(x, zero, np.full(50, n))
    assert (move(move(crcs, 13), 2000) == move(crcs, 2013)).all() and (move(crcs, 0) == crcs).all()
    assert (move(crcs ^ crcs[::-1], 77) == move(crcs, 77) ^ move(crcs[::-1].copy(), 77)).all()


def test_words_like_the_expression():
    for text in ["Ab-cD_é1 \x7f\x80x", "", None, "ß" * 5 + "\t9", "".join(map(chr, range(300)))]:
        assert word_bytes(text) == [w.encode() for w in grams_of(text, 1)[0]]


def test_target_like_text_is_drawn(spark):
    """One in ten documents speaks like the target: they are drawn before others, most of them."""
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"] if i % 10 == 0 else ["one", "two", "three", "four", "five"], k=40))) for i in range(400)]
    bench = spark.createDataFrame([(t,) for _, t in rows[::10][:5]], "text string")
    ranks = {x[0]: x[4] for x in got(resample(docs(spark, rows), bench))}
    assert sum(i % 10 == 0 for i, k in ranks.items() if k) == 40 == importance.PERCENT * 4
