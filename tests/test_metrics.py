import math

import pytest
from pyspark.sql import functions as F

from riskloom.contract import CostMatrix, SelectionParams
from riskloom.operators import drift, metrics, selection
from riskloom.operators.gate import Registry, decide


# The small vectors below are fixed values: published cases with their results.


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], "id int, label int, score double")


def test_average_precision(spark):
    ap = lambda y, s: metrics.auprc(scored(spark, y, s)).first()[0]
    assert ap([0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.9]) == 1.0
    assert ap([1] * 20 + [0] * 80, [0.5] * 100) == pytest.approx(0.2)
    assert ap([1, 1], [0.1, 0.2]) is None and ap([0, 0], [0.1, 0.2]) is None
    assert ap([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]) == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_recall_at_k(spark):
    df = scored(spark, [0, 1, 0, 1], [0.9, 0.8, 0.1, 0.05])
    assert [metrics.recall_at_k(df, k).first()[0] for k in (0, 1.5, 0.01, 0.5, 1)] == [None, None, 0.0, 0.5, 1.0]
    assert metrics.recall_at_k(scored(spark, [0, 0], [1, 2]), 0.5).first()[0] is None


def test_threshold_metrics(spark):
    df = scored(spark, [1, 1, 0, 0, 1, 0], [0.9, 0.8, 0.7, 0.4, 0.3, 0.2])
    assert tuple(metrics.classification(df, 0.75).first()) == pytest.approx((1, 2 / 3, 0, 2 / 6))
    assert tuple(metrics.confusion(scored(spark, [1, 0, 1, 0, 1], [0.9, 0.1, 0.4, 0.8, 0.6]), 0.5).first()) == (2, 1, 1, 1)
    assert metrics.expected_cost(scored(spark, [1, 1, 0, 0], [0.9, 0.2, 0.8, 0.1]), 0.5).first()["cost"] == 105
    none = metrics.classification(df.where("false"), 0.5).first()
    assert tuple(none) == (None,) * 4 and metrics.expected_cost(df.where("false"), 0.5).first()["cost_per_row"] is None


def test_threshold_choice(spark):
    df = scored(spark, [1, 1, 0, 0, 0, 1, 0], [0.95, 0.80, 0.10, 0.20, 0.30, 0.50, 0.70])
    got = metrics.select_threshold(df, recall_floor=0.1, alert_budget=0.6)
    assert (got["threshold"], got["cost"], got["recall"]) == (0.5, 5.0, 1.0) and got["flagged_rate"] == pytest.approx(4 / 7) and got["precision"] == 0.75
    with pytest.raises(ValueError):
        metrics.select_threshold(scored(spark, [1, 0, 0, 0], [0.5, 0.5, 0.5, 0.1]), alert_budget=0.5)
    assert metrics.select_threshold(scored(spark, [1, 0, 1, 0], [0.9, 0.6, 0.4, 0.1]), CostMatrix(0, 0), alert_budget=1.0)["threshold"] == 0.9


def test_report(spark):
    df = scored(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.9])
    r = metrics.report(df, 0.5, ks=(0.4,)).first()
    assert (r["auprc"], r["precision"], r["recall"], r["flagged_rate"], r["cost"], r["recall_at_0.4"]) == (1, 1, 1, 0.4, 0, 1) and r["brier"] == pytest.approx(0.038)
    r = metrics.report(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4]), 0.9).first()
    assert (r["cost"], r["cost_per_row"], r["recall"]) == (200, 50, 0)


def test_metrics_against_loops(spark):
    """Random labels and tied scores, each metric by its definition."""
    import random

    r = random.Random(3)
    for _ in range(3):
        rows = [(int(r.random() < 0.3), r.randrange(12) / 12) for _ in range(150)]
        df = scored(spark, *zip(*rows, strict=True))
        p = sum(y for y, _ in rows)
        at = {t: (sum(y for y, s in rows if s >= t), sum(s >= t for _, s in rows)) for t in {s for _, s in rows}}
        steps = sorted(at, reverse=True)
        ap = sum((at[t][0] - (at[steps[i - 1]][0] if i else 0)) / p * at[t][0] / at[t][1] for i, t in enumerate(steps))
        assert metrics.auprc(df).first()[0] == pytest.approx(ap)
        cost = {t: (p - hit) * 100.0 + (n - hit) * 5.0 for t, (hit, n) in at.items()}
        feasible = [t for t, (hit, n) in at.items() if hit / p >= 0.2 and n / 150 <= 0.7]
        assert metrics.select_threshold(df, recall_floor=0.2, alert_budget=0.7)["threshold"] == max(feasible, key=lambda t: (-cost[t], t))
        ranks = sorted(range(150), key=lambda i: (-rows[i][1], i))
        ks = (0.01, 0.1, 1.0)
        got = [x["recall"] for x in metrics.recalls_at_k(df, ks).orderBy("k").collect()]
        assert got == pytest.approx([sum(rows[i][0] for i in ranks[: max(1, math.ceil(150 * k))]) / p for k in ks])


def test_guards_and_weights(spark):
    with pytest.raises(ValueError):
        metrics.require_binary(scored(spark, [2], [0.1]))
    with pytest.raises(ValueError):
        metrics.require_binary(scored(spark, [1], [float("nan")]))
    assert metrics.class_weight(scored(spark, [1, 0, 0, 0], [0] * 4)).first()[0] == 3 and metrics.class_weight(scored(spark, [0, 0], [0, 0])).first()[0] == 1
    bins = {x["bin"]: x["n"] for x in metrics.reliability(scored(spark, [0, 1, 1], [0.1, 0.11, 1.0])).collect()}
    assert bins == {0: 1, 1: 1, 9: 1}


def test_gate_and_registry(tmp_path):
    assert [decide((0.6, 1), (0.5, 2)), decide((0.6, 3), (0.5, 2)), decide((0.4, 3), (0.5, 2)), decide((0.5, 2), (0.5, 2)), decide((0.5, 2), None), decide((math.nan, 1), (0.5, 2))] == ["promote", "reject", "reject", "promote", "bootstrap", "reject"]
    with pytest.raises(ValueError):
        decide((0.5, 1), (math.nan, 1))
    r = Registry(str(tmp_path))
    assert r.champion_metrics() is None
    v = r.add_version("run", {"a": "b"})
    r.promote(v, 0.1234567, 2.0, 0.3)
    assert r.version_of("champion") == v and r.champion_metrics() == (0.123457, 2.0) and r.tags(v)["a"] == "b" and r.run_of(v) == "run"
    r.set_alias("champion", r.add_version("x", {}))
    with pytest.raises(ValueError):
        r.champion_metrics()


def test_selection(spark):
    assert selection.v_columns(spark.createDataFrame([(1,) * 5], "V1 int, V12 int, Vx int, V int, card1 int")) == ["V1", "V12"]
    df = spark.range(200).select("id", (F.hash("id") % 100 / 100.0).alias("V1"), (F.hash(F.col("id") + 7) % 100 / 100.0).alias("V3"))
    df = df.select("*", (F.col("V1") * 3 + 1).alias("V2"), F.when(F.col("id") % 4 == 0, 1.0).alias("V4"), (F.col("V1") > 0).cast("int").alias("y"))
    kept = selection.select_block(df, "y", "id", SelectionParams(max_missing=0.5, max_correlation=0.9, min_periods=50))
    assert kept == ["V1", "V3"]
    rates = {x["column"]: x["rate"] for x in selection.missing_rates(df, ["V1", "V4"]).collect()}
    assert rates == {"V1": 0.0, "V4": 0.75}
    assert selection.decorrelate({"a": 0.5, "b": 0.5, "c": 0.1}, {("a", "b"): -0.9, ("a", "c"): 0.2, ("b", "c"): 0.95}, 0.9) == ["a", "c"]


def test_selection_on_all_rows(spark):
    """With ``whole``, more rows than the sample's count too: V2 follows the label in rows that a sample of 60 leaves out."""
    df = spark.range(600).select("id", (F.pmod(F.hash("id"), F.lit(2))).alias("y"), (F.hash(F.col("id") + 7) % 100 / 100.0).alias("V1"))
    df = df.withColumn("V2", F.col("y") + (F.hash(F.col("id") + 9) % 100 / 50.0)).withColumn("V3", F.col("V2") * 2)
    few = SelectionParams(max_missing=0.5, max_correlation=0.9, min_periods=100, sample_rows=60, max_features=1)
    assert selection.select_block(df, "y", "id", few) == ["V1"]  # too few rows for any correlation
    assert selection.select_block(df, "y", "id", few, whole=True) == ["V2"]


def test_spearman_pairwise(spark):
    rows = [(i, float((i * 7) % 23) if i % 5 else None, float((i * i) % 19) if i % 7 else None) for i in range(120)]
    got = selection.spearman(spark.createDataFrame(rows, "id int, V1 double, V2 double"), ["V1", "V2"], "id", min_periods=10).first()["rho"]
    import pandas as pd

    p = pd.DataFrame(rows, columns=["id", "V1", "V2"]).dropna()
    assert got == pytest.approx(p["V1"].rank().corr(p["V2"].rank()))


def test_psi(spark):
    r = spark.range(3000).select(F.randn(1).alias("n"), F.randn(2).alias("stable"))
    now = spark.range(3000).select((F.randn(3) * 2 + 9).alias("shifted"), F.randn(4).alias("stable"))
    scores = {x["feature"]: x["psi"] for x in drift.psi(r.select((F.col("n") * 2 + 5).alias("shifted"), "stable"), now, ["shifted", "stable"]).collect()}
    assert scores["shifted"] > 0.2 > scores["stable"]
    base = r.select("stable")
    assert drift.psi(base, base, ["stable"]).first()["psi"] == pytest.approx(0)
    summary = drift.drift_summary(spark.createDataFrame(list(scores.items()), "feature string, psi double")).first()
    assert summary["drifted"] == 1 and summary["share"] == 0.5
    assert tuple(drift.drift_summary(spark.createDataFrame([], "feature string, psi double")).first()) == (0, 0.0, 0.0)
    top = drift.top_psi(spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.4)], "feature string, psi double"), 2)
    assert [x["feature"] for x in top.collect()] == ["b", "c"]


def test_distances(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x double") for v in ([1.0, 2.0, 3.0], [2.0, 3.0, 4.0]))
    got = drift.distribution_distances(a, b, "x").first()
    assert got["ks"] == pytest.approx(1 / 3) and got["wasserstein"] == pytest.approx(1.0)


def test_latch_and_cooldown(spark):
    rows = [(0, True), (1, True), (2, True), (3, False), (4, True), (5, None), (6, True)]
    df = spark.createDataFrame(rows, "t int, b boolean")
    got = [x["fires"] for x in drift.breach_latch(df, order="t", breached=F.col("b"), required=2).orderBy("t").collect()]
    assert got == [False, True, False, False, False, False, True]
    times = spark.createDataFrame([("k", float(t)) for t in (0, 10, 50, 60, 125)], "k string, t double")
    assert sorted(x["t"] for x in drift.cooldown(times, by="k", at_s="t", seconds=60).collect()) == [0, 60, 125]


def test_drift_report(spark):
    a = spark.createDataFrame([(float(i % 10), float(i)) for i in range(200)] + [(None, float("nan"))], "x double, y double")
    b = spark.createDataFrame([(float(i % 10) + 3, float(i)) for i in range(200)], "x double, y double")
    got = {r["feature"]: r for r in drift.drift_report(a, b, ["x", "y"]).collect()}
    one = drift.distribution_distances(a, b, "x").first()
    assert got["x"]["ks"] == pytest.approx(one["ks"]) and got["x"]["wasserstein"] == pytest.approx(3) and got["x"]["psi"] > 0.2
    assert got["y"]["ks"] == 0 and got["y"]["wasserstein"] == 0


def test_association_against_ranks(spark):
    """Rank correlation with the label where nine of ten values are one value."""
    import random

    import pandas as pd

    r = random.Random(2)
    rows = [(i, i % 2, 1.0 if r.random() < 0.9 else r.random(), None if r.random() < 0.3 else r.random() + (i % 2) / 3, 5.0) for i in range(600)]
    got = {x["column"]: x["strength"] for x in selection.label_association(spark.createDataFrame(rows, "id int, y int, V1 double, V2 double, V3 double"), ["V1", "V2", "V3"], "y", "id", 100).collect()}
    p = pd.DataFrame(rows, columns=["id", "y", "V1", "V2", "V3"])
    for c in ("V1", "V2"):
        q = p[["y", c]].dropna()
        assert got[c] == pytest.approx(abs(q["y"].rank().corr(q[c].rank())))
    assert got["V3"] == 0.0


def test_spearman_of_many_patterns(spark):
    """Columns that miss rows alike and unlike, ties, a constant, an empty one, NaN: as pandas has it, over tiles of any size."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    n = 500
    base = r.normal(size=(n, 3))
    wide = pd.DataFrame({f"V{k}": np.round(base[:, k % 3] + r.normal(size=n) * (k + 1) / 4, 1) for k in range(12)} | {"V12": np.ones(n), "V13": np.full(n, np.nan)})
    for k in range(12):
        wide.loc[np.flatnonzero(np.arange(n) % 5 == k % 4), f"V{k}"] = np.nan  # four patterns
    wide.loc[r.random(n) < 0.95, "V11"] = np.nan
    rows = [(i, *[None if np.isnan(x) and (i + j) % 2 else float(x) for j, x in enumerate(row)]) for i, row in enumerate(wide.to_numpy())]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in wide.columns)).repartition(5)
    expected = wide.corr(method="spearman", min_periods=30)
    for cells in (10**9, 5 * n, n):
        got = {(x["a"], x["b"]): x["rho"] for x in selection.spearman(df, list(wide.columns), "id", 30, cells).collect()}
        assert set(got) == {(a, b) for a in wide.columns for b in wide.columns if a < b}
        for (a, b), rho in got.items():
            assert (rho is None and np.isnan(expected.loc[a, b])) or rho == pytest.approx(expected.loc[a, b], abs=1e-12), (a, b)
