"""Candidate models on MLlib: assemble, fit, tune, pick, calibrate, choose a threshold, gate, save and score.

Missing values: feature frames keep nulls. Leafwise trees learn a side for them at each split; for MLlib's models only, each null becomes a value
below the column's minimum and gets a column that marks it.
"""

from __future__ import annotations

import itertools
import math
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.contract import CostMatrix, Params, same_features
from riskloom.functions.ordering import ranked
from riskloom.operators import metrics, prepare
from riskloom.operators.boosting import Growth, LeafwiseModel, fit_leafwise
from riskloom.operators.gate import Registry, decide
from riskloom.operators.search import Choice, Span, maximise
from riskloom.sources.tables import content_hashes, read_json, write_json, written


@dataclass(frozen=True)
class Hyper:
    """Settings of all families: ``ridge`` is the linear model's; ``columns`` to ``min_curvature`` are those of ``boosting.Growth`` (``shrink``: its ridge)."""

    rounds: int = 40
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    min_rows: int = 20
    bins: int = 64
    ridge: float = 0.01
    trees: int = 60
    columns: float = 1.0
    shrink: float = 1.0
    lasso: float = 0.0
    min_gain: float = 0.0
    min_curvature: float = 0.0
    tolerance: float = 0.001
    seed: int = 42


def _gbt(h: Hyper) -> GBTClassifier:
    return GBTClassifier(maxIter=h.rounds, maxDepth=h.depth, stepSize=h.rate, subsamplingRate=h.subsample, minInstancesPerNode=h.min_rows, maxBins=h.bins, validationIndicatorCol="validating", validationTol=h.tolerance, weightCol="weight", seed=h.seed)


def _forest(h: Hyper) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=h.trees, maxDepth=h.depth + 2, subsamplingRate=h.subsample, minInstancesPerNode=h.min_rows, maxBins=h.bins, weightCol="weight", seed=h.seed)


def _linear(h: Hyper) -> LogisticRegression:
    return LogisticRegression(regParam=h.ridge, maxIter=h.rounds * 2, weightCol="weight")


#: Candidate families in order of preference: of equal ones the first is taken. ``leafwise`` has no estimator of MLlib: see ``boosting``.
FAMILIES: dict[str, Callable[[Hyper], object] | None] = {"gbt": _gbt, "leafwise": None, "forest": _forest, "linear": _linear}


@dataclass
class Bundle:
    """What scoring needs: model, calibrator, sentinels, feature order, threshold, provenance."""

    family: str
    features: list[str]
    fills: dict[str, float]
    model: object
    calibrator: IsotonicRegressionModel | None = None
    threshold: float = 0.5
    version: int = 0
    info: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``raw_score``, and ``score`` and ``decision`` once calibrated."""
        read = df if self.family == "leafwise" else with_fills(df, self.features, self.fills)
        out = self.model.transform(read).withColumn("raw_score", vector_to_array("probability")[1])
        out = out.drop("rawPrediction", "probability", "prediction", *[f"{c}__filled" for c in self.features], *[f"{c}__missing" for c in self.features], "features")
        if self.calibrator is None:
            return out
        return calibrated(out, self.calibrator).withColumn("decision", F.col("score") >= self.threshold)

    def save(self, path: str) -> None:
        """Models by MLlib's writer; the manifest last, so a bundle without one is incomplete."""
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        digests = _digests(path, self.calibrator is not None)
        write_json({"digests": digests, "family": self.family, "features": self.features, "fills": self.fills, "threshold": self.threshold, "version": self.version, "calibrated": self.calibrator is not None, "info": self.info}, f"{path}/manifest.json")

    @classmethod
    def load(cls, path: str, contract: Sequence[str] | None = None) -> Bundle:
        """ValueError if the model's features aren't the contract's, or a file isn't the one that was saved."""
        m = read_json(f"{path}/manifest.json")
        found = _digests(path, m["calibrated"])
        if found != m["digests"]:
            raise ValueError(f"files differ from those saved: {sorted(k for k in found.keys() | m['digests'].keys() if found.get(k) != m['digests'].get(k))}")
        if contract is not None:
            same_features(m["features"], contract)
        calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if m["calibrated"] else None
        return cls(m["family"], m["features"], m["fills"], (LeafwiseModel if m["family"] == "leafwise" else PipelineModel).load(f"{path}/model"), calibrator, m["threshold"], m["version"], m["info"])


def _digests(path: str, calibrated: bool) -> dict[str, str]:
    """SHA-256 of each file of a saved bundle but its manifest, by its path within."""
    spark, out = SparkSession.getActiveSession(), {}
    for part in ("model", "calibrator")[: 1 + calibrated]:
        inside = f"/{os.path.basename(os.path.normpath(path))}/{part}/"
        out |= {f"{part}/{r['path'].split(inside, 1)[1]}": r["sha256"] for r in content_hashes(spark, f"{path}/{part}").collect()}
    return out


def importances(bundle: Bundle) -> DataFrame:
    """``feature, importance`` of a model: impurity gains of trees (splits of leafwise ones), magnitudes of coefficients; a feature and its mark of being missing count together."""
    if bundle.family == "leafwise":
        return SparkSession.getActiveSession().createDataFrame([(c, float(g)) for c, g in zip(bundle.features, bundle.model.gains, strict=True)], "feature string, importance double")
    stages = bundle.model.stages
    last = stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
    rows = [(c, float(values[2 * i] + values[2 * i + 1])) for i, c in enumerate(bundle.features)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def pick_rows(candidates: DataFrame, value: str, order: str) -> DataFrame:
    """The candidate with the highest value; undefined ones count as the lowest, of equal ones the first by ``order`` wins."""
    x = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.col(value))
    return candidates.orderBy(F.coalesce(x, F.lit(float("-inf"))).desc(), order).limit(1)


def sentinels(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: (row[c] if row[c] is not None and math.isfinite(row[c]) else 0.0) - 1.0 for c in features}


def with_fills(df: DataFrame, features: Sequence[str], fills: dict[str, float]) -> DataFrame:
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.withColumns({f"{c}__filled": F.coalesce(clean(c), F.lit(fills[c])) for c in features} | {f"{c}__missing": clean(c).isNull().cast("double") for c in features})


def fit(train: DataFrame, val: DataFrame, features: Sequence[str], family: str, h: Hyper = Hyper(), *, label: str = "label") -> Bundle:
    """One family on train, boosting stopped early by val; positives weigh as much in all as negatives."""
    if family == "leafwise":
        weight = metrics.class_weight(train.select(F.col(label).alias("label"))).first()[0]
        growth = Growth(
            rounds=h.rounds, depth=h.depth, rate=h.rate, ridge=h.shrink, min_rows=h.min_rows, min_gain=h.min_gain, bins=h.bins, lasso=h.lasso,
            min_curvature=h.min_curvature, subsample=h.subsample, columns=h.columns, seed=h.seed, watch="auprc",
        )
        id = "id" if "id" in train.columns and "id" in val.columns else None
        return Bundle(family, list(features), {}, fit_leafwise(train, val, features, growth, label=label, weight=weight, id=id))
    fills = sentinels(train, features)
    weight = metrics.class_weight(train.select(F.col(label).alias("label"))).first()[0]
    both = train.withColumn("validating", F.lit(False)).unionByName(val.withColumn("validating", F.lit(True))) if family == "gbt" else train
    data = with_fills(both, features, fills).withColumn("weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(1.0))
    assembler = VectorAssembler(inputCols=[x for c in features for x in (f"{c}__filled", f"{c}__missing")], outputCol="features")
    estimator = FAMILIES[family](h).setLabelCol(label).setFeaturesCol("features")
    return Bundle(family, list(features), fills, PipelineModel([assembler, estimator.fit(assembler.transform(data))]))


def raw_scores(bundle: Bundle, df: DataFrame, label: str = "label", id: str = "id") -> DataFrame:
    return bundle.score(df).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col("raw_score").alias("score"))


_DEPTH, _RATE, _MIN_ROWS, _SHARE, _PENALTY = Span(3, 10, whole=True), Span(0.01, 0.3, log=True), Span(5, 50, log=True, whole=True), Span(0.5, 1.0), Span(1e-3, 10.0, log=True)
#: What the search may choose, by family: only settings that it reads.
SPACES = {
    "gbt": {"rounds": Choice((20, 40, 80)), "depth": _DEPTH, "rate": _RATE, "subsample": _SHARE, "min_rows": _MIN_ROWS},
    "leafwise": {
        "rounds": Span(40, 400, log=True, whole=True), "depth": _DEPTH, "rate": _RATE, "min_curvature": Span(0.5, 10.0, log=True), "subsample": _SHARE, "columns": _SHARE,
        "lasso": _PENALTY, "shrink": _PENALTY, "min_gain": Span(0.0, 5.0),
    },
    "forest": {"trees": Choice((20, 40, 60)), "depth": Span(3, 6, whole=True), "subsample": _SHARE, "min_rows": _MIN_ROWS},
    "linear": {"rounds": Choice((20, 40, 80)), "ridge": Span(1e-4, 1.0, log=True)},
}


def tune(train: DataFrame, val: DataFrame, features: Sequence[str], family: str = "gbt", trials: int = 10, seed: int = 42, timeout_s: float = 3600.0, clock: Callable[[], float] = time.monotonic) -> tuple[Hyper, float]:
    """Seeded search (``search.maximise``) for the best average precision on val; a trial that fails is passed over, none starts after ``timeout_s``. RuntimeError if all fail."""

    def value(chosen: dict) -> float | None:
        return metrics.auprc(raw_scores(fit(train, val, features, family, replace(Hyper(seed=seed), **chosen)), val)).first()["auprc"]

    chosen, best = maximise(value, SPACES[family], trials=trials, seed=seed, timeout_s=timeout_s, clock=clock)
    return replace(Hyper(seed=seed), **chosen), best


def pick_primary(candidates: dict[str, float | None]) -> str:
    """The highest value on val; undefined ones count as the lowest, of equal ones the first wins."""
    order = {k: v if v is not None and math.isfinite(v) else -math.inf for k, v in candidates.items()}
    return max(order, key=lambda k: order[k])


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Calibrator of ``(label, score)``; ValueError unless both classes are there.

    Rows of one score are one weighted row before anything is sorted, so a score that many rows share is no task of its own.
    """
    if not metrics.both_classes(scored).first()[0]:
        raise ValueError("calibration needs both classes")
    per = scored.groupBy(F.col("score").alias("raw_score")).agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight").fit(per)


def calibrated(df: DataFrame, calibrator: IsotonicRegressionModel) -> DataFrame:
    """Adds ``score`` for ``raw_score``, within 0 and 1: between two known scores on the line, beyond them the outermost value."""
    out = calibrator.transform(df)
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def calibrate(scored: DataFrame, params: Params = Params()) -> tuple[IsotonicRegressionModel, float]:
    """Calibrator and threshold from validation rows ``(id, label, raw_score)``: one half of them, dealt by label, makes the calibrator,
    the other chooses the threshold on calibrated scores, at the six decimals that tags have."""
    halves = written(prepare.stratified_folds(scored, k=2, label="label", id="id", seed=params.seed), "halves")
    calibrator = fit_isotonic(halves.where("fold = 0").select("label", F.col("raw_score").alias("score")))
    chosen = metrics.select_threshold(calibrated(halves.where("fold = 1"), calibrator).select("id", "label", "score"), params.cost, recall_floor=params.recall_floor, alert_budget=params.alert_budget)
    return calibrator, round(chosen["threshold"], 6)


def gate_inputs(test: DataFrame, threshold: float, costs: CostMatrix = CostMatrix()) -> tuple[float, float]:
    """Average precision of raw scores and cost for each row of calibrated ones, over ``(label, raw_score, score)``; NaN where undefined."""
    ap = metrics.auprc(test.select("label", F.col("raw_score").alias("score"))).first()["auprc"]
    cost = metrics.expected_cost(test, threshold, costs).first()["cost_per_row"]
    return ap if ap is not None else math.nan, cost if cost is not None else math.nan


def split_metrics(bundle: Bundle, df: DataFrame, ks: Sequence[float]) -> DataFrame:
    """``split, auprc`` and recalls of rows that carry ``split``, every split in the same jobs."""
    scored = bundle.score(df).select("id", "label", "split", F.col("raw_score").alias("score"))
    scored = written(scored, "split-scores")
    out = metrics.auprc(scored, by=["split"])
    for k in ks:
        n = scored.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
        top = ranked(scored, "score", ["id"], "r", groups=["split"], descending=True).join(n, "split").where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(k))))
        out = out.join(top.groupBy("split").agg((F.sum("label") / F.nullif(F.first("pos"), F.lit(0))).alias(f"recall_at_{k:g}")), "split")
    return out


def train_and_gate(df: DataFrame, features: Sequence[str], registry: Registry, params: Params = Params(), h: Hyper = Hyper(), families: Sequence[str] = tuple(FAMILIES), root: str | None = None) -> tuple[Bundle, dict]:
    """The whole run over rows ``(id, label, split, features)``: returns the challenger and what was decided.

    The best family on val is calibrated on one half of val and gets its threshold on the other, at the six decimals that tags have. The gate compares
    average precision of raw scores and cost of calibrated scores on test with the champion's. The challenger is saved below ``root`` (the registry's
    folder) under its version; a winner then gets its tags and at last the alias, so who follows the alias finds its files and metrics.
    """
    part = {s: df.where(F.col("split") == s).drop("split") for s in prepare.SPLIT_ORDER}
    fitted = {f: fit(part["train"], part["val"], features, f, h) for f in families}
    aps = {f: metrics.auprc(raw_scores(b, part["val"])).first()["auprc"] for f, b in fitted.items()}
    bundle = fitted[pick_primary(aps)]
    bundle.calibrator, bundle.threshold = calibrate(bundle.score(part["val"]).select("id", "label", "raw_score"), params)
    test = written(bundle.score(part["test"]).select("id", "label", "raw_score", "score"), "test-scores")
    challenger = gate_inputs(test, bundle.threshold, params.cost)
    verdict = decide(challenger, registry.champion_metrics())
    bundle.version = registry.add_version(bundle.family, {})
    bundle.info = {"val_auprc": aps, "test_auprc": challenger[0], "test_cost": challenger[1], "decision": verdict}
    bundle.save(f"{root or registry.root}/{bundle.version}")
    if verdict in ("promote", "bootstrap"):
        registry.promote(bundle.version, challenger[0], challenger[1], bundle.threshold)
    return bundle, bundle.info


def backtest(bundle: Bundle, holdout: DataFrame, costs: CostMatrix = CostMatrix(), ks: Sequence[float] = (0.005, 0.01, 0.05)) -> DataFrame:
    """The report of calibrated scores on rows never used before."""
    return metrics.report(bundle.score(holdout).select("id", "label", "score"), bundle.threshold, costs, ks)


def check_provenance(bundle: Bundle, expected: dict | None) -> bool:
    """False where nothing is known of the run; ValueError where what is known differs."""
    if expected is None:
        return False
    wrong = {k: (v, bundle.info.get(k)) for k, v in expected.items() if bundle.info.get(k) != v}
    if wrong:
        raise ValueError(f"another run made this model: {wrong}")
    return True


class Reloader:
    """Loads the champion, and again when its alias moves; a version that fails to load leaves the old one in place."""

    def __init__(self, spark: SparkSession, registry: Registry, root: str, contract: Sequence[str] | None = None):
        self.spark, self.registry, self.root, self.contract = spark, registry, root, contract
        self.bundle: Bundle | None = None
        self.failures = 0

    def current(self) -> Bundle | None:
        version = self.registry.version_of("champion")
        if version is not None and (self.bundle is None or self.bundle.version != version):
            try:
                self.bundle = Bundle.load(f"{self.root}/{version}", self.contract)
            except Exception:
                self.failures += 1
        return self.bundle


def load_with_retry(load: Callable[[], Bundle], deadline_s: float, sleep: Callable[[float], None], clock: Callable[[], float], backoff: Callable[[int], float]) -> Bundle:
    """Call ``load`` until it succeeds; after the deadline its last error is raised."""
    end = clock() + deadline_s
    for attempt in itertools.count():
        try:
            return load()
        except Exception:
            wait = backoff(attempt)
            if clock() + wait > end:
                raise
            sleep(wait)
    raise AssertionError
