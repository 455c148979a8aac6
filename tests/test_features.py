import math

import pytest
from pyspark.sql import functions as F

from riskloom import contract
from riskloom.functions import scalars as S
from riskloom.functions.ordering import ranked, running
from riskloom.operators import encode, prepare, velocity

S_US = 1_000_000


def tx(spark, rows):
    return spark.createDataFrame([(i, c, int(t * S_US), a) for i, (c, t, a) in enumerate(rows)], "id bigint, card string, us bigint, amount double")


def test_timestamps_and_card_ids(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 5.0), (86400, 1.0, None, 3.0, 5.0)], "TransactionDT bigint, card1 double, card2 double, card3 double, card5 double")
    got = S.add_keys_and_timestamp(df).orderBy("TransactionDT").select("card_id", F.col("event_timestamp").cast("string")).collect()
    assert [tuple(x) for x in got] == [("1_2_3_5", "2017-12-01 00:00:00"), ("1_na_3_5", "2017-12-02 00:00:00")]
    with pytest.raises(Exception, match="fractional"):
        df.withColumn("card1", F.lit(1.5)).select(S.make_card_id()).collect()


def test_velocity_fixture(spark):
    rows = [("A", 0, 10.0), ("A", 3600, 20.0), ("A", 100000, 5.0), ("B", 50, 7.0)]
    got = {x["id"]: x for x in velocity.seconds_since_previous(velocity.velocity(tx(spark, rows))).collect()}
    assert [(got[i]["v_count"], got[i]["v_sum"], got[i]["v_mean"], got[i]["v_max"], got[i]["gap_s"]) for i in range(4)] == [(0, 0, 0, 0, -1), (1, 10, 10, 10, 3600), (0, 0, 0, 0, 96400), (0, 0, 0, 0, -1)]


def test_velocity_ties_and_boundary(spark):
    ties = [("A", t, a) for t, a in ((0, 1.0), (100, 10.0), (100, 100.0), (100, 1000.0), (200, 5.0))]
    got = sorted(velocity.seconds_since_previous(velocity.velocity(tx(spark, ties))).collect(), key=lambda x: x["id"])
    assert [x["v_count"] for x in got] == [0, 1, 1, 1, 4] and [x["v_sum"] for x in got] == [0, 1, 1, 1, 1111] and [x["gap_s"] for x in got] == [-1, 100, 0, 0, 100]
    edge = [("A", 0, 1.0), ("A", 86400, 2.0), ("A", 86401, 4.0), ("A", 90000, None), ("A", 90001, 1.0)]
    got = sorted(velocity.velocity(tx(spark, edge)).collect(), key=lambda x: x["id"])
    assert [x["v_count"] for x in got][:3] == [0, 1, 1] and [x["v_sum"] for x in got][:3] == [0, 1, 2] and got[4]["v_count"] == 2


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 50), (4, "b", 1), (5, None, 9), (6, "a", 10**9)], "id int, card string, us bigint")
    right = spark.createDataFrame([("a", 10, 1, "x"), ("a", 10, 2, "y"), ("a", 20, 3, "z"), ("c", 0, 4, "w"), (None, 1, 5, "n")], "card string, us bigint, tie int, v string")
    run = lambda **o: {x["id"]: x["v"] for x in velocity.asof_join(left, right, by="card", us="us", right_tie="tie", values=["v"], **o).collect()}
    for width in (7, 15, 10**6):
        assert run(width_us=width) == {1: None, 2: "y", 3: "z", 4: None, 5: None, 6: "z"}
    assert run(tolerance_us=30, width_us=8) == {1: None, 2: "y", 3: "z", 4: None, 5: None, 6: None}


def test_latest_and_bounds(spark):
    df = tx(spark, [("A", 1, 1.0), ("A", 2, 2.0), ("A", 2, 3.0), ("B", 9, 4.0)])
    assert {x["card"]: x["amount"] for x in velocity.latest_per_card(df).collect()} == {"A": 3.0, "B": 4.0}
    assert {x["card"]: x["amount"] for x in velocity.latest_per_card(df, as_of_us=S_US).collect()} == {"A": 1.0}
    with pytest.raises(Exception, match="nothing to materialise"):
        velocity.materialization_bounds(df.where("false").withColumn("ts", F.timestamp_micros("us"))).collect()


def test_online_equals_offline(spark):
    """The snapshot as of a time serves what the as-of join gives at that time."""
    df = velocity.velocity(tx(spark, [("A", 0, 10.0), ("A", 3600, 20.0), ("A", 7200, 30.0), ("B", 0, 7.0), ("B", 1800, 9.0)]))
    cut = 4000 * S_US
    entities = spark.createDataFrame([("A", cut), ("B", cut), ("C", cut)], "card string, us bigint")
    offline = {x["card"]: x["v_sum"] for x in velocity.asof_join(entities, df, by="card", us="us", right_tie="id", values=["v_sum"]).collect()}
    online = {x["card"]: x["v_sum"] for x in velocity.lookup_latest(entities, velocity.latest_per_card(df, as_of_us=cut), card="card", fills={"v_sum": 0.0}).collect()}
    assert offline == {"A": 10.0, "B": 7.0, "C": None} and online == {"A": 10.0, "B": 7.0, "C": 0.0}


def test_scalars(spark):
    df = spark.createDataFrame([(20.0, 10.0), (10.0, 0.0), (10.0, None), (None, 5.0)], "a double, m double")
    assert [x[0] for x in df.select(S.amount_to_mean_ratio(F.col("a"), F.col("m"))).collect()] == [2.0, 1.0, 1.0, 1.0]
    text = spark.createDataFrame([("x",), ("2.0",), ("1e300",), ("Infinity",), ("NaN",), (None,)], "v string")
    assert [x[0] for x in text.select(S.coerce_numeric(F.col("v"))).collect()] == [None, 2.0, None, None, None, None]
    keys = spark.createDataFrame([(13.0,), (13.5,), (None,), (1e19,), (float("inf"),)], "v double").select(S.number_key(F.col("v"))).collect()
    assert [x[0] for x in keys][:3] == ["13", "13.5", None] and len({x[0] for x in keys}) == 5
    assert [x[0] for x in spark.createDataFrame([("13.0",), ("13",), ("M1",), ("13.5",)], "v string").select(S.text_key(F.col("v"))).collect()] == ["13", "13", "M1", "13.5"]
    fill = spark.createDataFrame([(None, float("nan"))], "card_txn_count_24h double, seconds_since_prev_txn double")
    assert tuple(S.fill_missing_velocity(fill).first()) == (0.0, -1.0)
    assert spark.sql("select 1 as x").select(S.hash_u32(42, F.lit(17))).first()[0] == 2470515424
    t = spark.createDataFrame([(None, 9.0), (5.0, 5.0), (400.0, 9.0)], "p double, want double")
    assert all(x[0] == x[1] for x in t.select(S.event_time_seconds(F.col("p"), F.lit(10.0), F.lit(9.0), 300.0), "want").collect())
    assert S.backoff_s(3, 0.5, 30) == 4.0 and S.backoff_s(20, 0.5, 30) == 30


def test_ranks_and_totals(spark):
    rows = [(i, (i * 37) % 50, "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, g string")
    got = {x["id"]: x["r"] for x in ranked(df, "k", ["id"], "r", groups=["g"], descending=True).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    top = {x["id"]: x["m"] for x in running(df, "k", ["id"], {"m": F.col("id")}, how="max").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert all(top[r[0]] == max(x[0] for x in order[: i + 1]) for i, r in enumerate(order))
    assert ranked(df.where("false"), "k", ["id"]).collect() == []


def test_contract():
    assert len(contract.feature_columns([f"V{i}" for i in range(30)])) == 117
    with pytest.raises(ValueError, match="lacks"):
        contract.same_features(["a"], ["a", "b"])
    with pytest.raises(TypeError):
        contract.Params.from_dict({"unknown": 1})
    with pytest.raises(ValueError):
        contract.Params.from_dict({"smoothing": -1.0})
    with pytest.raises(ValueError):
        contract.CostMatrix(-1, 0)
    for bad in ((), (0.5, 0.25), (0.1, 0.1), (0.0, 1.0), (0.5, 1.5)):
        with pytest.raises(ValueError):
            contract.CanaryParams(steps=bad)
    assert contract.Params.from_dict({"canary": {"steps": [0.1, 1.0]}}).canary.steps == (0.1, 1.0)


def test_merge_and_contract_columns(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "TransactionID int")
    right = spark.createDataFrame([(2, 5.0)], "TransactionID int, id_01 double")
    got = {x["TransactionID"]: x["id_01"] for x in prepare.merge_one_to_one(left, right, "TransactionID").collect()}
    assert got == {1: None, 2: 5.0, 3: None}
    with pytest.raises(ValueError, match="right"):
        prepare.merge_one_to_one(left, right.union(right), "TransactionID")
    with pytest.raises(KeyError, match="amt_log"):
        prepare.select_contract(left, ["amt_log"])
    with pytest.raises(ValueError, match="both sides"):
        prepare.append_columns(right, "TransactionID", right)


def test_downcast(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 1.5), (-100, 5, 0, None)], "a bigint, b bigint, c bigint, d double")
    assert dict(prepare.downcast(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float"}


def test_validation(spark):
    rows = [(1, 0, 5, 1.0, "W"), (2, 2, 5, 1.0, "Z"), (3, 1, 0, -1.0, None)]
    df = spark.createDataFrame(rows, "TransactionID int, isFraud int, TransactionDT int, TransactionAmt double, ProductCD string")
    got = {x["rule"]: x["failures"] for x in prepare.validation_report(df, prepare.transaction_rules()).collect()}
    assert got == {"id_not_negative": 0, "label_binary": 1, "time_positive": 1, "amount_positive": 1, "product_known": 2}
    rate = lambda n, k: prepare.label_rate_gate(spark.range(n).select((F.col("id") < k).cast("int").alias("y")), "y").first()["passed"]
    assert rate(1000, 5) and rate(100, 15) and not rate(1000, 4) and not rate(100, 16) and not rate(0, 0)


def test_time_split(spark):
    df = spark.range(10).select("id", (F.col("id") * 7).alias("t"))
    out = prepare.time_split(df, key="t", tie="id", val=0.2, test=0.2, holdout=0.2)
    prepare.assert_chronological(out, "t")
    assert {x["split"]: x["n"] for x in prepare.split_bounds(out, "t").collect()} == {"train": 4, "val": 2, "test": 2, "holdout": 2}
    with pytest.raises(ValueError, match="no training rows"):
        prepare.time_split(df, key="t", tie="id", val=0.4, test=0.4, holdout=0.4)
    tied = spark.createDataFrame([(i, t) for i, t in enumerate([1, 2, 3, 4, 5, 6, 6, 7, 8, 9])], "id int, t int")
    with pytest.raises(ValueError, match="overlap"):
        prepare.assert_chronological(prepare.time_split(tied, key="t", tie="id", val=0.2, test=0.2, holdout=0.2), "t")
    with pytest.raises(ValueError):
        prepare.check_split_name("nope")


def test_samples_and_folds(spark):
    df = spark.range(1000).select("id", (F.col("id") >= 950).cast("int").alias("y"))
    got = prepare.stratified_sample(df, size=200, label="y", id="id")
    assert got.count() == 200 and got.agg(F.sum("y")).first()[0] == 10
    assert sorted(x[0] for x in got.select("id").collect()) == sorted(x[0] for x in prepare.stratified_sample(df, size=200, label="y", id="id").select("id").collect())
    assert prepare.stratified_sample(df, size=5000, label="y", id="id").count() == 1000
    folds = prepare.stratified_folds(df, k=5, label="y", id="id").groupBy("fold", "y").count().collect()
    assert len(folds) == 10 and {x["count"] for x in folds} == {190, 10}
    with pytest.raises(ValueError):
        prepare.require_enough_per_class(df.where("id <= 950"), "y", 5)


def test_encoder(spark):
    df = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "b", 1), (3, "b", 1)], "id int, c string, y int")
    table, prior = encode.fit_encoder(df, ["c"], "y", smoothing=2)
    got = {x["key"]: (x["freq"], x["target"]) for x in table.collect()}
    assert prior == 0.75 and got["a"] == (0.5, 0.625)
    new = spark.createDataFrame([(0, "zz"), (1, "b")], "id int, c string")
    out = {x["id"]: (x["c_freq"], x["c_target"]) for x in encode.transform_encoder(new, table, prior, ["c"], "id").collect()}
    assert out[0] == (0.0, 0.75) and out[1][0] == 0.5
    gaps = spark.createDataFrame([(0, None, 1), (1, "__missing__", 0), (2, "x", 0), (3, "x", 0)], "id int, c string, y int")
    table, prior = encode.fit_encoder(gaps, ["c"], "y", smoothing=0)
    t = {x["key"]: (x["freq"], x["target"]) for x in table.collect()}
    assert t[None] == (0.25, 1.0) and t["__missing__"] == (0.25, 0.0)
    numbers = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 1.0)], "id int, c double")
    assert {x["key"]: x["freq"] for x in encode.frequency_map(numbers, ["c"]).collect()} == {"1": 0.5, "2": 0.25, None: 0.25}


def test_out_of_fold(spark):
    df = spark.createDataFrame([(i, "rare" if i == 0 else "common", int(i == 0 or i % 4 == 0)) for i in range(40)], "id int, c string, y int")
    folded = prepare.stratified_folds(df, k=5, label="y", id="id")
    got = {x["id"]: x["target_oof"] for x in encode.oof_targets(folded, ["c"], "y", "fold", "id", smoothing=0).collect()}
    rows = folded.collect()
    for r in rows:
        rest = [x for x in rows if x["fold"] != r["fold"]]
        same = [x["y"] for x in rest if x["c"] == r["c"]] or [x["y"] for x in rest]
        assert math.isclose(got[r["id"]], sum(same) / len(same))
    assert got[0] < 1.0
