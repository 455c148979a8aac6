"""Ranks, running totals and trailing windows where one key has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import ordering
from riskloom.operators import velocity


def test_rows_that_share_a_key_are_many_ranges(spark):
    r = random.Random(4)
    rows = [(5.0 if r.random() < 0.9 else r.random() * 10, i, r.randrange(9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "key double, id bigint, x bigint")
    for descending in (False, True):
        order = sorted(rows, key=lambda t: (-t[0] if descending else t[0], t[1]))
        got = {x["id"]: x["r"] for x in ordering.ranked(df, "key", ["id"], "r", descending=descending).collect()}
        assert got == {t[1]: n + 1 for n, t in enumerate(order)}
        total, expected = 0, {}
        for t in order:
            total += t[2]
            expected[t[1]] = total
        assert {x["id"]: x["s"] for x in ordering.running(df, "key", ["id"], {"s": F.col("x")}, descending=descending).collect()} == expected
    sizes = df.withColumn("range", ordering._ranges(df, "key", ["id"], 64, False)).groupBy("range").count()
    assert sizes.agg(F.max("count")).first()[0] < 400
    text = df.withColumn("id", F.lpad(F.col("id").cast("string"), 5, "0"))  # ties that aren't numbers stay in one range
    got = {int(x["id"]): x["r"] for x in ordering.ranked(text, "key", ["id"], "r").collect()}
    assert got == {t[1]: n + 1 for n, t in enumerate(sorted(rows, key=lambda t: (t[0], t[1])))}


@pytest.mark.parametrize(("window", "inclusive", "parts"), [(160, False, 1), (160, True, 1), (160, False, 16), (160, True, 16), (7, True, 1), (7, False, 7), (1, False, 1), (1, True, 1)])
def test_trailing_against_a_loop(spark, window, inclusive, parts):
    """Nine of ten rows have one key; times tie, values, keys and times are missing."""
    r = random.Random(window)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", None]), None if r.random() < 0.05 else r.randrange(600) - 300, None if r.random() < 0.1 else float(r.randrange(50)), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t bigint, x double, id bigint")
    out = ordering.trailing(df, by=["k"], at="t", window=window, inclusive=inclusive, count={"n": "x"}, total={"s": "x"}, largest={"m": "x"}, parts=parts)
    assert out.columns == [*df.columns, "n", "s", "m"]
    for g in out.collect():
        if g["t"] is None:
            assert (g["n"], g["s"], g["m"]) == (0, None, None)
            continue
        lo, hi = (g["t"] - window + 1, g["t"]) if inclusive else (g["t"] - window, g["t"] - 1)
        seen = [x for k, t, x, _ in rows if k == g["k"] and t is not None and lo <= t <= hi and x is not None]
        assert (g["n"], g["s"], g["m"]) == (len(seen), sum(seen) if seen else None, max(seen, default=None))


def test_a_card_is_many_tasks(spark):
    """The rows of one card in a window are cut into sixteen parts."""
    df = spark.range(8000).select(F.lit("c").alias("card"), (F.col("id") * 10).alias("us"), F.lit(1.0).alias("amount"), "id")
    out = velocity.velocity(df, window_us=16_000, parts=16)
    assert out.agg(F.max("v_count"), F.max("v_sum")).first() == (1600, 1600.0)
    parts = df.groupBy(F.floor(F.col("us") / 1000)).count()
    assert parts.agg(F.max("count")).first()[0] == 100


def test_trailing_shuffles_once(spark):
    """One exchange below both running aggregates, whatever the number of values."""
    df = spark.range(100).select((F.col("id") % 3).alias("card"), F.col("id").alias("us"), F.col("id").cast("double").alias("amount"), F.lit("x").alias("other"))
    plan = velocity.velocity(df, window_us=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(ValueError, match="divide"):
        ordering.trailing(df, by=["card"], at="us", window=10, inclusive=True, count={"n": "amount"}, parts=3)


def test_quantiles_are_exact(spark):
    """Many ties, few values, one value, none: as numpy has them; brackets of large groups hold the place."""
    import numpy as np

    r = random.Random(9)
    groups = {"many": [r.gauss(0, 1) for _ in range(30_000)], "ties": [float(r.randrange(5)) for _ in range(2000)], "skew": [0.0] * 900 + [r.random() for _ in range(100)], "two": [1.0, 4.0], "one": [7.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("many", None), ("none", None), (None, 2.0), (None, 3.0)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {x["g"]: x["q"] for x in ordering.quantiles(df, "g", "x", shares).collect()}
    assert got.keys() == {*groups, None} and got[None] == pytest.approx(np.quantile([2, 3], shares))
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, shares).tolist(), abs=1e-12)
    assert "percentile(" not in ordering.quantiles(df, "g", "x", shares)._jdf.queryExecution().toString()


def test_previous_over_stretches(spark):
    r = random.Random(1)
    times = r.sample(range(-500, 4000), 300)
    rows = [(r.choice(["a", "b", None]), t, None if r.random() < 0.1 else r.random()) for t in times]
    got = {x["t"]: x["p"] for x in ordering.previous(spark.createDataFrame(rows, "k string, t bigint, x double"), by=["k"], order=["t"], value="x", name="p", stretch=100).collect()}
    for k in ("a", "b", None):
        mine = sorted(((t, x) for g, t, x in rows if g == k), key=lambda v: v[0])
        assert [got[t] for t, _ in mine] == [None, *[x for _, x in mine[:-1]]]


def test_ordered_fold_over_batches(spark):
    """A key's rows come in order through any number of batches; its state is all that is kept."""
    class Trace:
        def __init__(self):
            self.seen, self.parts = [], 0

    def step(state, part):
        state.seen += part["t"].tolist()
        state.parts += 1
        return [(None, None, -t) for t in part["t"] if t == 37]  # rows on the way

    rows = [(k, t) for k, n in (("hot", 5000), ("a", 3), (None, 40), ("b", 1)) for t in random.Random(2).sample(range(n), n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = ordering.ordered_fold(spark.createDataFrame(rows, "k string, t bigint"), by="k", order=["t"], start=Trace, step=step, end=lambda s: (len(s.seen), s.seen == sorted(s.seen), s.parts), schema="k string, n bigint, ordered boolean, parts bigint")
        every = out.collect()
        got = {x["k"]: x for x in every if x["n"] is not None}
        assert sorted(str(x["k"]) for x in every if x["parts"] == -37) == ["None", "hot"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: x["n"] for k, x in got.items()} == {"hot": 5000, "a": 3, None: 40, "b": 1} and all(x["ordered"] for x in got.values())
    assert got["hot"]["parts"] >= 5000 // 64
