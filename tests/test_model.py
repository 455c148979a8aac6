import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.contract import Params
from riskloom.operators import model, prepare
from riskloom.operators.gate import Registry


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    made = []
    for i in range(1200):
        y = int(r.random() < 0.4)
        made.append((i, i, y, r.gauss(1.5 * y, 1), None if r.random() < 0.2 else r.gauss(0, 1)))
    df = spark.createDataFrame(made, "id int, us bigint, label int, a double, b double")
    return prepare.time_split(df, key="us", tie="id", val=0.2, test=0.2, holdout=0.2).persist()


def test_train_gate_backtest(spark, rows, tmp_path):
    registry = Registry(str(tmp_path))
    small = model.Hyper(rounds=4, depth=2, trees=4)
    bundle, info = model.train_and_gate(rows, ["a", "b"], registry, Params(alert_budget=0.9), small, families=("linear", "gbt"))
    assert info["decision"] == "bootstrap" and registry.version_of("champion") == 1 and info["test_auprc"] > 0.6
    report = model.backtest(bundle, rows.where("split = 'holdout'").drop("split")).first()
    assert report["n"] == 240 and report["auprc"] > 0.6 and 0 <= report["brier"] < 0.3
    per = {x["split"]: x["auprc"] for x in model.split_metrics(bundle, rows, (0.05,)).collect()}
    assert set(per) == set(prepare.SPLIT_ORDER) and per["test"] == pytest.approx(info["test_auprc"])
    bundle.save(f"{tmp_path}/1")
    again = model.Bundle.load(f"{tmp_path}/1", ["a", "b"])
    one = lambda b: {x["id"]: (x["score"], x["decision"]) for x in b.score(rows.where("id < 40")).collect()}
    assert one(again) == one(bundle)
    with pytest.raises(ValueError, match="lacks"):
        model.Bundle.load(f"{tmp_path}/1", ["a", "b", "c"])
    weights = {x["feature"]: x["importance"] for x in model.importances(bundle).collect()}
    assert set(weights) == {"a", "b"} and weights["a"] > weights["b"] >= 0
    victim = next(p for p in sorted((tmp_path / "1" / "model").rglob("*.parquet")))
    good = victim.read_bytes()
    (victim.parent / f".{victim.name}.crc").unlink()  # the file system's own check would come first
    victim.write_bytes(good + b"x")
    with pytest.raises(ValueError, match="differ"):
        model.Bundle.load(f"{tmp_path}/1", ["a", "b"])
    victim.write_bytes(good)
    reloader = model.Reloader(spark, registry, str(tmp_path))
    assert reloader.current().version == 1
    registry.set_alias("champion", registry.add_version("x", {}))
    assert reloader.current().version == 1 and reloader.failures == 1
    assert model.check_provenance(bundle, None) is False and model.check_provenance(bundle, {"decision": "bootstrap"})
    with pytest.raises(ValueError):
        model.check_provenance(bundle, {"decision": "promote"})


def test_champion_has_its_files(spark, rows, tmp_path):
    """Whoever follows the alias finds the files, the tags and the same threshold, from the moment it moves."""
    seen = []

    class Watched(Registry):
        def set_alias(self, alias, version):
            served = model.Bundle.load(f"{tmp_path}/{version}", ["a", "b"])
            seen.append((served.version, f"{served.threshold:.6f}" == self.tags(version)["threshold"], served.threshold == float(self.tags(version)["threshold"])))
            super().set_alias(alias, version)

    registry = Watched(str(tmp_path))
    bundle, _ = model.train_and_gate(rows, ["a", "b"], registry, Params(alert_budget=0.9), model.Hyper(rounds=4), families=("linear",))
    assert seen == [(1, True, True)]
    served = model.Reloader(spark, registry, str(tmp_path)).current()
    some = rows.where("id < 40")
    assert {x["id"]: x["decision"] for x in served.score(some).collect()} == {x["id"]: x["decision"] for x in bundle.score(some).collect()}

    class Full(Registry):
        def write_tags(self, version, tags):
            raise OSError("no space")

    with pytest.raises(OSError):
        model.train_and_gate(rows, ["a", "b"], Full(str(tmp_path)), Params(alert_budget=0.9), model.Hyper(rounds=4), families=("linear",))
    assert registry.version_of("champion") == 1


def test_registry_and_bundle_below_a_url(spark, rows, tmp_path):
    """Versions, aliases and models of a shared folder that is a URL are read and written there."""
    root = f"file://{tmp_path}/shared"
    bundle, info = model.train_and_gate(rows, ["a"], Registry(root), Params(alert_budget=0.9), model.Hyper(rounds=2), families=("linear",))
    assert info["decision"] == "bootstrap" and (tmp_path / "shared" / "registry.json").exists()
    served = model.Reloader(spark, Registry(root), root, ["a"]).current()
    assert served.version == 1 and served.threshold == bundle.threshold and Registry(root).champion_metrics() == pytest.approx((info["test_auprc"], info["test_cost"]), abs=1e-6)


def test_pick_and_tune(rows):
    assert model.pick_primary({"a": None, "b": 0.3, "c": 0.3, "d": math.nan}) == "b" and model.pick_primary({"a": math.nan, "b": None}) == "a"
    part = {s: rows.where(F.col("split") == s).drop("split") for s in ("train", "val")}
    h, value = model.tune(part["train"], part["val"], ["a"], "linear", trials=2)
    assert value > 0.5 and h.rounds in (20, 40, 80)
    with pytest.raises(RuntimeError):
        model.tune(part["train"], part["val"], ["nope"], "linear", trials=1)
    ticks = iter([0.0, 1.0, 99.0])
    assert model.tune(part["train"], part["val"], ["a"], "linear", trials=50, timeout_s=10, clock=lambda: next(ticks))[1] > 0.5  # one trial, then time is up
    with pytest.raises(ValueError):
        model.fit_isotonic(part["val"].where("label = 1").withColumn("score", F.lit(0.5)))


def test_isotonic_of_shared_scores(spark):
    """A score that a third of the rows share: the calibrator is that of the single rows, by plain pooling."""
    r = random.Random(5)
    made = [(int(r.random() < x), x) for x in (0.5 if r.random() < 0.4 else round(r.random(), 2) for _ in range(700))]
    fitted = model.fit_isotonic(spark.createDataFrame(made, "label int, score double").repartition(5))
    pools = []
    for x in sorted({x for _, x in made}):
        ys = [y for y, v in made if v == x]
        pools.append([[x], sum(ys), len(ys)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            xs, s, n = pools.pop()
            pools[-1] = [pools[-1][0] + xs, pools[-1][1] + s, pools[-1][2] + n]
    expected = {x: s / n for xs, s, n in pools for x in xs}
    rows = spark.createDataFrame([(x,) for x in [*expected, -1.0, 2.0]], "raw_score double")
    got = {x["raw_score"]: x["score"] for x in model.calibrated(rows, fitted).collect()}
    assert {x: got[x] for x in expected} == pytest.approx(expected) and got[-1.0] == pytest.approx(pools[0][1] / pools[0][2]) and got[2.0] == pytest.approx(pools[-1][1] / pools[-1][2])


def test_calibrate_uses_disjoint_halves(spark):
    """The threshold comes from rows that the calibrator has not seen, at six decimals; limits that nothing meets raise."""
    df = spark.createDataFrame([(i, int(i * 7 % 20 < i % 10), (i % 10) / 10) for i in range(400)], "id int, label int, raw_score double")
    calibrator, threshold = model.calibrate(df, Params(recall_floor=0.2, alert_budget=0.5))
    halves = prepare.stratified_folds(df, k=2, label="label", id="id", seed=42)
    own = model.fit_isotonic(halves.where("fold = 0").select("label", F.col("raw_score").alias("score")))
    assert list(calibrator.predictions) == list(own.predictions) and threshold == round(threshold, 6)
    seen = {round(x["score"], 6) for x in model.calibrated(halves.where("fold = 1"), own).collect()}
    assert threshold in seen
    test = model.calibrated(df, calibrator)
    ap, cost = model.gate_inputs(test, threshold)
    assert 0 < ap < 1 and cost > 0
    assert all(map(math.isnan, model.gate_inputs(test.limit(0), threshold)))
    with pytest.raises(ValueError, match="no threshold"):
        model.calibrate(df, Params(recall_floor=1.0, alert_budget=0.01))


def test_retry():
    now = [0.0]
    calls = []

    def load():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    def sleep(s):
        now[0] += s

    assert model.load_with_retry(load, 10, sleep, lambda: now[0], lambda n: 2.0**n) == "ok"
    with pytest.raises(OSError):
        model.load_with_retry(lambda: (_ for _ in ()).throw(OSError()), 3, sleep, lambda: now[0], lambda n: 2.0)
