"""Vector codes against a plain version with whole numbers of any size; ties, unused entries, what is left out."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import codes
from riskloom.llm.codes import assign, encode_vectors

VECTORS = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(7) for c in ("v", "x", "code", "error", "of", "part", "total", "n", "length")})


def plain(rows, parts=8, entries=16, rounds=6):
    """One vector after another, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, m: tuple(v[m * width : (m + 1) * width])
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v, m) for _, v in first] for m in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, m: min((far(cut(v, m), c), e) for e, c in enumerate(books[m]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for m in range(parts):
                groups.setdefault((m, nearest(v, m)[1]), []).append(cut(v, m))
        for (m, e), vs in groups.items():
            books[m][e] = tuple(sum(col) // len(vs) for col in zip(*vs, strict=True))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [(i, y, [nearest(v, m) for m in range(parts)]) for i, v, y in kept]
    total = {}
    for _, y, best in found:
        total[y] = total.get(y, 0) + sum(d for d, _ in best)
    return sorted(((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), total[y], digest) for i, y, best in found), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_against_a_plain_version(spark):
    """Few distinct values make ties and entries that nothing is nearest to; labels are missing, vectors repeat."""
    r = random.Random(1)
    rows = [(i * 3, [float(np.float32(r.choice([r.gauss(0, 1), 0.25, -0.5]))) for _ in range(16)], r.choice([0, 1, 1, None])) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 5) for i in range(60)] + [(-5, [0.25] * 16, None), (-4, [0.25] * 16, 2), (None, rows[3][1], 2)]
    rows += [(7, None, 1), (8, [0.1] * 15 + [None], 1), (10, [0.1] * 15 + [math.nan], 1), (11, [math.inf] + [0.1] * 15, 1), (13, [-math.inf] + [0.1] * 15, None)]
    r.shuffle(rows)
    assert rows_of(encode_vectors(table(spark, rows).repartition(5))) == plain(rows)


def test_bytes_that_vanish_and_large_numbers(spark):
    """Floors of small negative numbers, components of ten thousands: distances stay exact."""
    r = random.Random(2)
    rows = [(i, [float(np.float32(x)) for x in (-1e-7, 1e-7, *(r.uniform(-130_000, 130_000) for _ in range(6)))], i % 2) for i in range(40)]
    assert rows_of(encode_vectors(table(spark, rows))) == plain(rows)
    assert max(x[2] for x in plain(rows)) > 2**53


def test_nearest_is_the_first_of_equals():
    v, books = np.array([[[5]], [[7]]]), np.array([[[4], [6], [8], [6]]])
    nearest, away = assign(v, books)
    assert nearest.tolist() == [[0, 1]] and away.tolist() == [[1, 1]]


def test_few_ids_repeats_and_lengths(spark):
    same = [0.5] * 8
    rows = [(3, same, 1), (3, same, 1), (9, [0.25] * 8, 1), (None, [0.125] * 8, None), (4, [1.0] * 9, 1), (5, [], 2), (6, [3e38] * 8, 1)]
    got = rows_of(encode_vectors(table(spark, rows)))
    assert [g[0] for g in got] == [3, 3, 9, None] and got[0] == got[1]
    distinct = plain([rows[0], rows[2], rows[3]])  # an id that repeats starts one entry; its parts count twice, which moves no entry that holds them alone
    assert [g[:3] for g in got if g[0] != 3] == [g[:3] for g in distinct if g[0] != 3] and got[0][1:3] == next(g[1:3] for g in distinct if g[0] == 3)
    none = encode_vectors(table(spark, [(1, None, 1), (2, [], None)]))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert encode_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    ragged = encode_vectors(table(spark, [(i, [float(i), 1.0, 2.0], 0) for i in range(20)]), parts=2, entries=4)
    assert {len(x["code"]) for x in ragged.collect()} == {4}
    with pytest.raises(ValueError):
        encode_vectors(table(spark, rows), entries=257)


def test_labels_beyond_the_bound(spark, monkeypatch):
    """Without a broadcast, and with one label for most rows: the same sums."""
    r = random.Random(6)
    rows = [(i, [r.random() for _ in range(8)], None if i % 5 else i) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    monkeypatch.setattr(codes, "maybe_broadcast", lambda df, *_: df)
    assert rows_of(encode_vectors(table(spark, rows))) == plain(rows)
