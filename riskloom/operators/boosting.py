"""Boosted trees grown by the best leaf, with a learned side for missing values, on binned rows."""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import hash_u32
from riskloom.sources.tables import written

#: Trees after which the margins of all rows are written, so that later passes don't score them again.
SAVE_EVERY = 10
#: Rounds without a better loss on validation rows after which boosting ends.
PATIENCE = 50


@dataclass(frozen=True)
class Growth:
    """How trees grow: at most ``leaves`` leaves (2^depth - 1 unless given, at least 2) and ``depth`` levels.

    A side of a split has at least ``min_rows`` rows and ``min_curvature`` curvature, and the split a gain above ``min_gain``. Gradients
    shrink by ``lasso`` and curvatures grow by ``ridge`` before they are held against each other. Each tree reads the ``subsample`` share of
    rows and the ``columns`` share of features (rounded, at least one) that hang on ``seed`` and its number alone. ``watch`` says what ends
    boosting: ``loss`` or ``auprc`` on validation rows.
    """

    rounds: int = 40
    depth: int = 5
    leaves: int | None = None
    rate: float = 0.1
    ridge: float = 1.0
    min_rows: int = 20
    min_gain: float = 0.0
    bins: int = 64
    patience: int = PATIENCE
    lasso: float = 0.0
    min_curvature: float = 0.0
    subsample: float = 1.0
    columns: float = 1.0
    seed: int = 42
    watch: str = "loss"

    def __post_init__(self) -> None:
        if not (0 < self.subsample <= 1 and 0 < self.columns <= 1):
            raise ValueError("subsample and columns must lie in (0, 1]")
        if self.watch not in ("loss", "auprc"):
            raise ValueError("watch must be loss or auprc")

    def pull(self, g: np.ndarray) -> np.ndarray:
        """Gradients, nearer to zero by ``lasso``."""
        return np.sign(g) * np.maximum(np.abs(g) - self.lasso, 0.0)

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """What a leaf of these sums takes off the loss, twice; 0 for an empty one."""
        below = h + self.ridge
        return np.divide(self.pull(g) ** 2, below, out=np.zeros(np.broadcast(g, below).shape), where=below > 0)

    def step(self, g: float, h: float) -> float:
        """The value of a leaf."""
        return float(-self.rate * self.pull(g) / (h + self.ridge)) if h + self.ridge > 0 else 0.0

    def features_of(self, tree: int, n: int) -> list[int]:
        """The features that a tree reads, of n, in order."""
        return sorted(random.Random(f"{self.seed}:{tree}").sample(range(n), max(1, round(n * self.columns))))

    def rows_of(self, tree: int, keys: np.ndarray) -> np.ndarray:
        """Whether a tree reads each row, by the row's key: shares of a bit mixer's range."""
        if self.subsample == 1:
            return np.ones(len(keys), bool)
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((self.seed * 2**32 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(self.subsample * 2**53))

    @property
    def most_leaves(self) -> int:
        return max(2, self.leaves or 2**self.depth - 1)


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), the last bin that goes left, whether missing goes left, children, and a leaf's value."""

    feature: list[int] = field(default_factory=list)
    upto: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (255: missing)."""
        feature, upto, missing, left, right = (np.asarray(x) for x in (self.feature, self.upto, self.missing_left, self.left, self.right))
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while (inner := feature[at] >= 0).any():
            r = rows[inner]
            n = at[r]
            b = binned[r, feature[n]]
            at[r] = np.where(np.where(b == 255, missing[n], b <= upto[n]), left[n], right[n])
        return at


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Upper bounds of each feature's bins: its quantiles by sketches that merge, each once; NaN and null are absent."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must lie in 2 to 255")
    shares = [i / bins for i in range(1, bins)]
    one = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(one[i] or [])) for i in range(len(features))]


def to_bins(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of rows of values: how many edges lie below each; 255 where it is missing."""
    out = np.empty(values.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), 255, np.searchsorted(np.asarray(e, np.float64), values[:, k], side="left"))
    return out


def _total(histogram: np.ndarray) -> np.ndarray:
    """A node's sums, from a feature that its tree reads: the others have no rows."""
    sums = histogram.sum(axis=1)
    return sums[sums[:, 2].argmax()]


def best_split(histogram: np.ndarray, growth: Growth) -> tuple[float, int, int, bool] | None:
    """``gain, feature, upto, missing_left`` of a node, from its sums (feature, bin, gradient | curvature | rows), the missing in the last bin; None if there is none.

    Of equal gains the first feature counts, then the lower bin, then missing to the left.
    """
    total = _total(histogram)
    upto = histogram[:, :-1].cumsum(axis=1)[:, :-1]
    best = None
    for missing_left in (True, False):
        left = upto + (histogram[:, -1:] if missing_left else 0)
        right = total - left
        fits = np.logical_and.reduce([(side[..., 2] >= max(growth.min_rows, 1)) & (side[..., 1] >= growth.min_curvature) for side in (left, right)])
        gain = np.where(fits, growth.worth(left[..., 0], left[..., 1]) + growth.worth(right[..., 0], right[..., 1]) - growth.worth(total[0], total[1]), -np.inf)
        k = int(gain.argmax())
        f, b = divmod(k, gain.shape[1])
        found = (float(gain[f, b]), -f, -b, missing_left)
        if found[0] > growth.min_gain + 1e-12 and (best is None or found[0] > best[0] + 1e-12 or (abs(found[0] - best[0]) <= 1e-12 and found[1:3] > best[1:3])):
            best = found
    return best and (best[0], -best[1], -best[2], best[3])


def grow(histograms: Callable[[Tree, list[int]], dict[int, np.ndarray]], growth: Growth) -> Tree:
    """A tree by its best leaf first. ``histograms`` gives the sums of some nodes of a tree, by number.

    A leaf's gain doesn't hang on the order of splits, so whole levels are summed at once: ``depth`` passes for all that might be split.
    Then the leaf with the highest gain is split, again and again, until there are as many as may be.
    """
    full = Tree([-1], [0], [True], [-1], [-1], [0.0])
    splits: dict[int, tuple] = {}
    level, sums = [0], {}
    for depth in range(growth.depth + 1):
        got = histograms(full, level)
        sums |= {n: _total(got[n]) for n in level}
        if depth == growth.depth:
            break
        below = []
        for n in level:
            split = best_split(got[n], growth)
            if split:
                splits[n] = split
                full.feature[n], full.upto[n], full.missing_left[n] = split[1:]
                full.left[n], full.right[n] = len(full.feature), len(full.feature) + 1
                below += [full.left[n], full.right[n]]
                for values, empty in ((full.feature, -1), (full.upto, 0), (full.missing_left, True), (full.left, -1), (full.right, -1), (full.value, 0.0)):
                    values += [empty, empty]
        level = below
        if not level:
            break
    kept, leaves, waiting = set(), 1, [(-splits[0][0], 0)] if 0 in splits else []
    while waiting and leaves < growth.most_leaves:
        _, n = heapq.heappop(waiting)
        kept.add(n)
        leaves += 1
        for child in (full.left[n], full.right[n]):
            if child in splits:
                heapq.heappush(waiting, (-splits[child][0], child))
    for n in range(len(full.feature)):
        if n not in kept:
            full.feature[n] = -1
        g, h = sums[n][:2] if n in sums else (0.0, 0.0)
        full.value[n] = growth.step(g, h)
    return full


class LeafwiseModel:
    """Trees, the features they read, the edges of their bins and the margin that they start from."""

    def __init__(self, features: Sequence[str], edges: list[list[float]], start: float, trees: list[Tree], gains: Sequence[float] = ()):
        self.features, self.edges, self.start, self.trees, self.gains = list(features), edges, start, trees, list(gains)

    def margins(self, binned: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(binned))
        for tree in self.trees[first:]:
            out += np.asarray(tree.value)[tree.nodes(binned)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, a vector of both classes' shares. Nulls and NaN take the side that each split has learnt."""
        @F.pandas_udf("double")
        def score(values: pd.DataFrame) -> pd.Series:
            margin = self.start + self.margins(to_bins(values.to_numpy(np.float64), self.edges))
            return pd.Series(1 / (1 + np.exp(-margin)))

        p = score(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]))
        return df.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p")

    # The writer's three steps, as models of the library have them.

    def write(self) -> LeafwiseModel:
        return self

    def overwrite(self) -> LeafwiseModel:
        return self

    def save(self, path: str) -> None:
        text = json.dumps({"features": self.features, "edges": self.edges, "start": self.start, "trees": [asdict(t) for t in self.trees], "gains": self.gains})
        SparkSession.getActiveSession().createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> LeafwiseModel:
        m = json.loads(SparkSession.getActiveSession().read.parquet(path).first()[0])
        return cls(m["features"], m["edges"], m["start"], [Tree(**t) for t in m["trees"]], m["gains"])


def margin_class(margin: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of margins: 2,048 classes for each power of two from 2^-10 to 2^5, below one class and above one, on either side of zero."""
    size = np.abs(margin)
    exponent = np.floor(np.log2(np.clip(size, 2.0**-10, 2.0**5 - 1e-9)))
    steps = (exponent + 10) * 2048 + np.floor((np.clip(size, 2.0**-10, 2.0**5 - 1e-9) / 2.0**exponent - 1) * 2048) + 1
    return (np.sign(margin) * np.where(size < 2.0**-10, 0, steps)).astype(np.int64)


def average_precision(classes: pd.DataFrame) -> float:
    """From ``bin, g, h``: positives and rows of each class of scores; NaN unless both labels are there."""
    down = classes.sort_values("bin", ascending=False)
    p, n = down["g"].to_numpy(), down["h"].to_numpy()
    if not 0 < p.sum() < n.sum():
        return math.nan
    return float((p * p.cumsum() / n.cumsum()).sum() / p.sum())


def _add(seen: dict[int, np.ndarray], at: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Adds the sums of g and h to those of each number."""
    known, place = np.unique(at, return_inverse=True)
    for k, x, y in zip(known.tolist(), np.bincount(place, g, len(known)), np.bincount(place, h, len(known)), strict=True):
        seen[k] = seen.get(k, 0.0) + np.array([x, y])


def fit_leafwise(train: DataFrame, val: DataFrame, features: Sequence[str], growth: Growth = Growth(), *, label: str = "label", weight: float = 1.0, id: str | None = None) -> LeafwiseModel:
    """Boosted trees for a 0/1 label on train, by the logistic loss; positives count ``weight`` times. Nulls and NaN are missing.

    Rows are binned once. For each level of a tree one pass sums gradients, curvatures and rows by node, feature and bin in each task, and the
    sums meet in a grouped shuffle of bounded size; only sums reach the driver. The first pass of a tree also gives the loss or the average
    precision (of margins in classes of ``margin_class``) on val up to then; after ``patience`` rounds without a better one boosting ends, and
    the trees up to the best round stay. Sampled rows follow a hash of ``id``; without one, of label and features, so equal rows go together.
    """
    features = list(features)
    edges = bin_edges(train, features, growth.bins)
    n_features, cells = len(features), growth.bins + 1
    numbers = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    y = F.col(label).cast("double")
    key = hash_u32(growth.seed, F.col(id)).cast("bigint") if id else F.xxhash64(y, *[F.col(c).cast("double") for c in features])
    part = lambda df, is_val: df.select(y.alias("y"), F.lit(is_val).alias("val"), F.coalesce(key, F.lit(0)).alias("key"), *numbers)
    rows = part(train, False).union(part(val, True))

    def bins_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = to_bins(b[[f"x{i}" for i in range(n_features)]].to_numpy(np.float64), edges)
            yield pd.DataFrame({"y": b["y"], "val": b["val"], "key": b["key"], "bins": [x.tobytes() for x in rows], "margin": 0.0})

    schema = "y double, val boolean, key bigint, bins binary, margin double"
    table = written(rows.mapInPandas(bins_of, schema), "binned-rows")
    y1, n = table.where("not val").agg(F.sum("y"), F.count("*")).first()
    pos, neg = weight * (y1 or 0.0), (n or 0) - (y1 or 0.0)
    model = LeafwiseModel(features, edges, math.log(pos / neg) if pos > 0 and neg > 0 else 0.0, [], [0.0] * n_features)
    saved, watched = 0, []

    def matrix(b: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), n_features)

    def histograms(tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        place = {node: k for k, node in enumerate(nodes)}
        so_far = LeafwiseModel(features, edges, model.start, model.trees[saved:])
        number, read = len(model.trees), growth.features_of(len(model.trees), n_features)
        first = nodes == [0]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, seen = np.zeros((len(nodes), n_features, cells, 3)), {}
            where = np.full(len(tree.feature), -1)
            where[list(place)] = list(place.values())
            for b in batches:
                if not len(b):
                    continue
                binned, y, val = matrix(b), b["y"].to_numpy(), b["val"].to_numpy(bool)
                margin = so_far.start + b["margin"].to_numpy() + so_far.margins(binned)
                p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, weight, 1.0)
                if first and growth.watch == "loss":
                    _add(seen, np.zeros(val.sum(), np.int64), (w * (np.logaddexp(0, margin) - y * margin))[val], w[val])
                elif first:
                    _add(seen, margin_class(margin[val]), y[val], np.ones(val.sum()))
                node = where[tree.nodes(binned)]
                mine = np.flatnonzero((node >= 0) & ~val & growth.rows_of(number, b["key"].to_numpy()))
                x = np.minimum(binned[mine], cells - 1).astype(np.int64)
                for k, values in enumerate((w * (p - y), w * p * (1 - p), np.ones(len(y)))):
                    for f in read:
                        sums[:, f, :, k] += np.bincount(node[mine] * cells + x[:, f], values[mine], len(nodes) * cells).reshape(len(nodes), cells)
            at = np.nonzero(sums[..., 2])
            yield pd.DataFrame({"node": at[0], "feature": at[1], "bin": at[2], "g": sums[(*at, 0)], "h": sums[(*at, 1)], "n": sums[(*at, 2)]})
            if seen:
                yield pd.DataFrame({"node": -1, "feature": 0, "bin": list(seen), "g": [v[0] for v in seen.values()], "h": [v[1] for v in seen.values()], "n": 0.0})

        got = table.mapInPandas(work, "node int, feature int, bin int, g double, h double, n double").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        out = np.zeros((len(nodes), n_features, cells, 3))
        told = got[got["node"] >= 0]
        out[told["node"], told["feature"], told["bin"]] = told[["g", "h", "n"]].to_numpy()
        if first:
            told = got[got["node"] < 0]
            watched.append(-average_precision(told) if growth.watch == "auprc" else told["g"].sum() / told["h"].sum() if len(told) else math.nan)
        return {node: out[k] for node, k in place.items()}

    for round_ in range(growth.rounds):
        tree = grow(histograms, growth)
        best = int(np.nanargmin(watched)) if not np.isnan(watched).all() else round_
        if round_ - best >= growth.patience or (tree.feature[0] < 0 and growth.subsample == growth.columns == 1):
            break
        model.trees.append(tree)
        if len(model.trees) - saved >= SAVE_EVERY and round_ + 1 < growth.rounds:
            added = LeafwiseModel(features, edges, 0.0, model.trees[saved:])

            def moved(batches: Iterator[pd.DataFrame], added: LeafwiseModel = added) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield b.assign(margin=b["margin"] + added.margins(matrix(b)) if len(b) else b["margin"])

            table, saved = written(table.mapInPandas(moved, schema), "binned-rows"), len(model.trees)
    else:
        histograms(Tree([-1], [0], [True], [-1], [-1], [0.0]), [0])  # what val says after the last tree
    if watched and not np.isnan(watched).all():
        del model.trees[int(np.nanargmin(watched)) :]
    for tree in model.trees:
        for f in tree.feature:
            if f >= 0:
                model.gains[f] += 1.0
    return model
