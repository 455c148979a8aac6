import pytest
from pyspark.sql import functions as F

from riskloom.contract import CATEGORICAL_COLUMNS, TRANSACTION_EVENT, MonitorParams, feature_columns
from riskloom.operators import encode, serving
from riskloom.streaming import matching, monitor


def test_assembled_row(spark):
    train = spark.createDataFrame([(i, "W" if i % 2 else "H", i % 2) for i in range(10)], "id int, ProductCD string, y int")
    train = train.withColumns({c: F.lit(None).cast("string") for c in CATEGORICAL_COLUMNS if c != "ProductCD"})
    encoder, prior = encode.fit_encoder(train, CATEGORICAL_COLUMNS, "y")
    raw = [(t, card, 10.0, "x", None if t == "3" else {"C1": 2.0, "v": {"V1": 7.0, "junk": 1.0}, "categorical": {"ProductCD": "W" if t == "1" else "?"}}) for t, card in (("1", "a"), ("2", "b"), ("3", "a"))]
    requests = spark.createDataFrame(raw, TRANSACTION_EVENT)
    snapshot = spark.createDataFrame([("a", 3.0, 30.0, 5.0, 20.0, 60.0)], "card_id string, card_txn_count_24h double, card_amt_sum_24h double, card_amt_mean_24h double, card_amt_max_24h double, seconds_since_prev_txn double")
    got = {x["transaction_id"]: x for x in serving.assemble_features(requests, snapshot, encoder, prior, ["V1", "V2"]).collect()}
    assert list(got["1"].asDict())[1:] == feature_columns(["V1", "V2"])
    assert (got["1"]["amt_to_card_mean_24h"], got["1"]["V1"], got["1"]["V2"], got["1"]["C1"], got["1"]["ProductCD_freq"]) == (2.0, 7.0, None, 2.0, 0.5)
    assert (got["2"]["card_txn_count_24h"], got["2"]["seconds_since_prev_txn"], got["2"]["amt_to_card_mean_24h"], got["2"]["ProductCD_freq"], got["2"]["ProductCD_target"]) == (0, -1, 1, 0, 0.5)
    assert got["3"]["C1"] is None and got["3"]["M1_freq"] == 1.0
    assert serving.drift_baseline(train, encoder, prior, ["ProductCD"], "id", rows=4).count() == 4
    with pytest.raises(ValueError):
        serving.register_feature("amt_log", lambda df: df)


def test_velocity_view(spark):
    df = spark.createDataFrame([("a", 0, 1, 10.0), ("a", 3600, 2, 20.0)], "card_id string, s bigint, TransactionID bigint, TransactionAmt double").withColumn("event_timestamp", F.timestamp_seconds("s"))
    got = {x["TransactionID"]: x for x in serving.velocity_view(df).collect()}
    assert got[2]["card_amt_sum_24h"] == 10 and got[2]["seconds_since_prev_txn"] == 3600 and got[1]["seconds_since_prev_txn"] == -1


def test_router(spark):
    cases = [("labels", '{"transaction_id":"1","is_fraud":1}', "ok"), ("labels", '{"transaction_id":"1","is_fraud":3}', "poison"), ("labels", "{", "poison"), ("labels", None, "ignored"), ("x", "{}", "ignored"), ("scored-features", '{"transaction_id":"1","model_version":1,"fraud_score":0.5,"decision":true,"features":{"a":null}}', "ok"), ("scored-features", '{"transaction_id":"1","model_version":0,"fraud_score":0.5}', "poison"), ("scored-features", '{"transaction_id":"1","model_version":1,"fraud_score":1.5}', "poison")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, topic string, value string")
    assert [x["status"] for x in monitor.route(df.orderBy("i").coalesce(1)).collect()] == [s for _, _, s in cases]


def test_cycle(spark):
    rolling = spark.createDataFrame([(300, 0.2, 1.0, 0.1)], "matched bigint, auprc double, cost double, flagged_rate double")
    row = monitor.cycle_row(rolling, spark.createDataFrame([("a", 0.4), ("b", 0.1)], "feature string, psi double"), 3).first()
    assert (row["cycle"], row["max_psi"], row["weak"]) == (3, 0.4, True)
    assert monitor.cycle_row(rolling, None, 4).first()["max_psi"] is None
    rows = {x["metric"]: x["value"] for x in monitor.metric_rows(rolling.withColumn("at", F.lit(9)), "at", ["auprc", "cost"]).collect()}
    assert rows == {"auprc": 0.2, "cost": 1.0}
    assert [x["labels"]["feature"] for x in monitor.psi_rows(spark.createDataFrame([("a", 0.4), ("b", 0.9)], "feature string, psi double"), 1, 1).collect()] == ["b"]
    lag = spark.createDataFrame([(None,), (5.0,), (12.0,)], "c double").select(monitor.clock_lag(F.lit(10.0), F.col("c")), monitor.event_clock(F.col("c"), F.lit(10.0), F.lit(1.0), MonitorParams(clock_skew_s=1))).collect()
    assert [tuple(x) for x in lag] == [(None, 1.0), (5.0, 5.0), (0.0, 1.0)]
    assert matching.below_floor() is not None
