"""Leaf-wise boosting against a plain version that searches every split, and what missing values and stops do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import hash_u32
from riskloom.operators import metrics, model
from riskloom.operators.boosting import Growth, LeafwiseModel, Tree, average_precision, best_split, fit_leafwise, grow, margin_class, to_bins


def rows(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.gauss(0, 1), r.choice([1.0, 2.0, 3.0, 5.0])
        missing = r.random() < 0.3
        y = int(r.random() < (0.85 if missing else 0.15 + 0.5 * (a > 0.3) + 0.2 * (b > 2)))
        out.append((i, y, None if missing else a, float("nan") if r.random() < 0.1 else b, r.random()))
    return out


SCHEMA = "id int, label int, a double, b double, c double"


def plain(x, y, edges, growth, weight, val_x, val_y, keys):
    """Every leaf, feature, bin and side is tried; the best leaf is split first; sums are made anew each time."""
    bins, val_bins = to_bins(x, edges), to_bins(val_x, edges)
    w = np.where(y == 1, weight, 1.0)
    start = np.log(w[y == 1].sum() / w[y == 0].sum())
    margin, val_margin, losses, trees = np.full(len(y), start), np.full(len(val_y), start), [], []
    pull = lambda g: max(abs(g) - growth.lasso, 0) * (1 if g > 0 else -1)
    score = lambda g, h: pull(g) ** 2 / (h + growth.ridge)
    for number in range(growth.rounds):
        read = growth.rows_of(number, keys)
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [(np.ones(len(y), bool), np.ones(len(val_y), bool), 0)]
        while len(leaves) < growth.most_leaves:
            best = None
            for k, (mask, _, depth) in enumerate(leaves):
                if depth == growth.depth:
                    continue
                for f in growth.features_of(number, x.shape[1]):
                    for upto in range(growth.bins - 1):
                        for missing_left in (True, False):
                            here = mask & read
                            left = here & np.where(bins[:, f] == 255, missing_left, bins[:, f] <= upto)
                            right = here & ~left
                            if min(left.sum(), right.sum()) < growth.min_rows or min(h[left].sum(), h[right].sum()) < growth.min_curvature:
                                continue
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[here].sum(), h[here].sum())
                            if gain > growth.min_gain + 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, k, f, upto, missing_left)
            if best is None:
                break
            _, k, f, upto, missing_left = best
            mask, val_mask, depth = leaves.pop(k)
            left, val_left = (np.where(b[:, f] == 255, missing_left, b[:, f] <= upto) for b in (bins, val_bins))
            leaves += [(mask & left, val_mask & val_left, depth + 1), (mask & ~left, val_mask & ~val_left, depth + 1)]
        losses.append((np.where(val_y == 1, weight, 1.0) * (np.logaddexp(0, val_margin) - val_y * val_margin)).sum())
        for mask, val_mask, _ in leaves:
            value = -growth.rate * pull(g[mask & read].sum()) / (h[mask & read].sum() + growth.ridge)
            margin[mask] += value
            val_margin[val_mask] += value
        trees.append(len(leaves))
    return margin, val_margin, trees


GROWTHS = [
    Growth(rounds=3, depth=3, bins=8, min_rows=15), Growth(rounds=2, depth=4, leaves=5, bins=6, rate=0.5, min_rows=5),
    Growth(rounds=4, depth=3, bins=6, rate=0.3, min_rows=1, ridge=0.5, lasso=1.5, min_curvature=4.0, min_gain=0.8, subsample=0.6, columns=0.67),
]


@pytest.mark.parametrize("growth", GROWTHS)
def test_against_a_plain_version(spark, growth):
    train, val = rows(400), rows(120, 2)
    df = lambda made: spark.createDataFrame(made, SCHEMA).repartition(3)
    fitted = fit_leafwise(df(train), df(val), ["a", "b", "c"], growth, weight=2.0, id="id")
    keys = np.array([r[0] for r in df(train).orderBy("id").select(hash_u32(growth.seed, F.col("id")).cast("bigint")).collect()])
    x, vx = (np.array([[np.nan if v is None else v for v in r[2:]] for r in made]) for made in (train, val))
    y, vy = (np.array([r[1] for r in made], float) for made in (train, val))
    margin, val_margin, leaves = plain(x, y, fitted.edges, growth, 2.0, vx, vy, keys)
    assert len(fitted.trees) == growth.rounds and [sum(f < 0 for f in _reached(t)) for t in fitted.trees] == leaves
    assert fitted.start + fitted.margins(to_bins(x, fitted.edges)) == pytest.approx(margin, abs=1e-9)
    assert fitted.start + fitted.margins(to_bins(vx, fitted.edges)) == pytest.approx(val_margin, abs=1e-9)
    got = {r["id"]: r["p"] for r in fitted.transform(df(train)).select("id", model.vector_to_array("probability")[1].alias("p")).collect()}
    assert [got[r[0]] for r in train] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)


def _reached(tree):
    out, waiting = [], [0]
    while waiting:
        n = waiting.pop()
        out.append(tree.feature[n])
        if tree.feature[n] >= 0:
            waiting += [tree.left[n], tree.right[n]]
    return out


def test_missing_values_take_the_better_side():
    """Rows without a value behave like those with a high one: they go right, in one split."""
    h = np.zeros((1, 4, 3))
    h[0, :, 0], h[0, :, 1], h[0, :, 2] = [-5, -4, 6, 7], [3, 3, 3, 3], [10, 10, 10, 10]
    gain, feature, upto, missing_left = best_split(h, Growth(bins=3, min_rows=1))
    assert (feature, upto, missing_left) == (0, 1, False) and gain > 0
    h[0, 3, 0] = -7
    assert best_split(h, Growth(bins=3, min_rows=1))[2:] == (1, True)
    assert best_split(h, Growth(bins=3, min_rows=21)) is None
    assert best_split(h, Growth(bins=3, min_rows=1, min_gain=1e9)) is None


def test_best_leaf_first():
    """With three leaves the second split goes to the side that gains more."""
    sums = {0: [(-9, 9, 9)] * 2 + [(9, 9, 9)] * 2, 1: [(-9, 9, 9), (-9, 9, 9), (0, 0, 0), (0, 0, 0)], 2: [(0, 0, 0), (0, 0, 0), (1, 9, 9), (17, 9, 9)]}
    made = lambda n: np.array([[*sums.get(n, [(0, 0, 0)] * 4), (0, 0, 0)]], float)
    tree = grow(lambda tree, nodes: {n: made(n) for n in nodes}, Growth(depth=2, leaves=3, bins=4, min_rows=1))
    assert tree.feature[0] == 0 and tree.feature[1] < 0 and tree.feature[2] == 0 and sum(f < 0 for f in _reached(tree)) == 3


def test_early_stop_keeps_the_best_round(spark):
    """Labels of the validation rows are the other way round: no tree helps, none stays."""
    df = spark.createDataFrame(rows(300), SCHEMA)
    upside = df.withColumn("label", 1 - F.col("label"))
    assert fit_leafwise(df, upside, ["a", "b"], Growth(rounds=9, depth=2, patience=2, rate=0.5)).trees == []
    assert len(fit_leafwise(df, df, ["a"], Growth(rounds=12, depth=2)).trees) == 12  # beyond the point where margins are written


def test_samples_hang_on_seed_and_tree_alone():
    growth, keys = Growth(subsample=0.3, columns=0.5, seed=7), np.arange(-5000, 5000)
    read = [growth.rows_of(t, keys) for t in range(6)]
    assert all(abs(r.mean() - 0.3) < 0.03 for r in read) and abs((read[0] & read[1]).mean() - 0.09) < 0.02
    assert (growth.rows_of(2, keys[::-1])[::-1] == read[2]).all() and (Growth(subsample=0.3, seed=8).rows_of(0, keys) != read[0]).any()
    assert (Growth(subsample=0.6, seed=7).rows_of(0, keys) | ~read[0]).all()  # a larger share holds the smaller one
    assert all(len(growth.features_of(t, 5)) == 2 for t in range(9)) and {f for t in range(30) for f in growth.features_of(t, 5)} == set(range(5))
    assert Growth(columns=0.01).features_of(0, 3) and len(Growth().features_of(4, 3)) == 3
    for wrong in ({"subsample": 0}, {"columns": 1.1}, {"watch": "luck"}):
        with pytest.raises(ValueError):
            Growth(**wrong)


def test_penalties():
    h = np.zeros((1, 3, 3))
    h[0, :2] = [[-5, 3, 10], [4, 3, 10]]
    gain = best_split(h, Growth(bins=2, min_rows=1))[0]
    assert gain == pytest.approx(25 / 4 + 16 / 4 - 1 / 7)
    assert best_split(h, Growth(bins=2, min_rows=1, lasso=1))[0] == pytest.approx(16 / 4 + 9 / 4)
    assert best_split(h, Growth(bins=2, min_rows=1, min_curvature=3.1)) is None and best_split(h, Growth(bins=2, min_rows=1, lasso=9)) is None
    assert Growth(rate=0.5, lasso=2).step(-5, 2) == pytest.approx(0.5) and Growth(ridge=0).step(1, 0) == 0


def test_average_precision_of_margin_classes(spark):
    """Margins of a few trees are far apart: the classes give the value of exact scores."""
    r = random.Random(4)
    values = np.array([r.choice([-3.5, -0.7, -0.001, 0, 0.0004, 0.2, 0.21, 40.0]) for _ in range(500)])
    labels = [int(r.random() < 0.3 + 0.1 * (v > 0)) for v in values]
    order = margin_class(np.array([-99.0, -33.0, -2.0, -1.999, -1e-9, 0, 0.001, 0.002, 1.0, 31.9, 99.0]))
    assert (np.diff(order) >= 0).all() and len(set(order)) == 9 and abs(order).max() <= 15 * 2048
    at = margin_class(values)
    table = [(int(k), float(sum(y for y, a in zip(labels, at) if a == k)), float((at == k).sum())) for k in set(at.tolist())]
    frame = spark.createDataFrame(table, "bin int, g double, h double").toPandas()
    flushed = np.where(abs(values) < 2.0**-10, 0.0, values)
    assert average_precision(frame) == pytest.approx(metrics.auprc(spark.createDataFrame([(y, float(v)) for y, v in zip(labels, flushed)], "label int, score double")).first()[0])
    assert np.isnan(average_precision(frame.assign(g=0.0))) and np.isnan(average_precision(frame.iloc[:0]))


def test_average_precision_ends_boosting(spark):
    """A second validation set with labels the other way round: the first margins, all equal, stay the best."""
    df = spark.createDataFrame(rows(300), SCHEMA)
    growth = Growth(rounds=8, depth=2, patience=2, rate=0.5, watch="auprc", subsample=0.7, columns=0.7)
    assert fit_leafwise(df, df.withColumn("label", 1 - F.col("label")), ["a", "b"], growth).trees == []
    assert len(fit_leafwise(df, df, ["a", "b"], growth).trees) > 0
    assert len(fit_leafwise(df, df.where("label = 1"), ["a"], growth).trees) == 8  # no such value with one class: every round stays


def test_bundle_of_leafwise_trees(spark, tmp_path):
    df = spark.createDataFrame(rows(400), SCHEMA)
    bundle = model.fit(df, df, ["a", "b", "c"], "leafwise", model.Hyper(rounds=3, depth=3))
    assert bundle.fills == {} and not any(c.endswith("__missing") for c in bundle.score(df).columns)
    bundle.save(f"{tmp_path}/7")
    again = model.Bundle.load(f"{tmp_path}/7", ["a", "b", "c"])
    one = lambda b: {r["id"]: r["raw_score"] for r in b.score(df).collect()}
    assert one(again) == one(bundle) and isinstance(again.model, LeafwiseModel)
    weights = {r["feature"]: r["importance"] for r in model.importances(bundle).collect()}
    assert weights["a"] > 0 and set(weights) == {"a", "b", "c"}
    assert Tree([-1], [0], [True], [-1], [-1], [1.5]).nodes(np.zeros((3, 2), np.uint8)).tolist() == [0, 0, 0]
