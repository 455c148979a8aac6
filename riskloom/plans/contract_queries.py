"""Queries over sources and sinks, contracts and guards, serving rows, and the small column functions."""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import functions as F

from riskloom.contract import CanaryParams, CostMatrix, Params, encoded_feature_names, require_columns, same_features
from riskloom.functions import scalars as S
from riskloom.operators import encode, metrics, model, prepare, serving, velocity
from riskloom.operators.gate import Registry
from riskloom.plans.registry import big, query, r6, rounded
from riskloom.sources.tables import TRANSACTIONS_SQL, columns_matching, driver_folder, load, new_path, read_csv, read_json, transactions, wide_block, wide_block_sql, write_json, write_table
from riskloom.streaming import matching, monitor, scoring

# -- Sources and sinks


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events")
def csv_scan(spark, d):
    """All columns written as CSV, three of them read under a schema."""
    path = new_path(spark, "csv")
    load(spark, d, "events").withColumn("ts", F.col("ts").cast("string")).write.csv(path, header=True)
    back = read_csv(spark, path, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string", ["event_id", "user_id", "value"])
    return rounded(back)


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def table_overwrite(spark, d):
    """The second write replaces the first."""
    path, e = new_path(spark, "overwritten"), load(spark, d, "events", ["event_id", "event_type"])
    write_table(e, path)
    write_table(e.where("event_id % 2 = 0"), path)
    return spark.read.parquet(path)


@query("SELECT i - 1 AS position, 'V' || i AS name FROM generate_series(1, 64) t(i)")
def frozen_list(spark, d):
    """The names of the wide block, frozen as JSON and read again."""
    path = f"{os.path.join(driver_folder(spark), 'selected.json')}"
    write_json(columns_matching(wide_block(spark, d).columns), path)
    return spark.createDataFrame(list(enumerate(read_json(path))), "position bigint, name string")


@query("SELECT event_id::VARCHAR AS key, '{\"transaction_id\":\"' || event_id || '\",\"decision\":' || (value >= 50)::VARCHAR || '}' AS value, CASE WHEN event_id % 5 = 0 THEN 'reason=rejected' ELSE '' END AS headers FROM events")
def keyed_log_rows(spark, d):
    """Predictions and dead letters as a keyed log takes them."""
    e = load(spark, d, "events", ["event_id", "value"])
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("transaction_id"), (F.col("value") >= 50).alias("decision")))
    good = scoring.keyed(e.where("event_id % 5 <> 0"), "event_id", body)
    dead = scoring.dead_letters(e.where("event_id % 5 = 0").select(F.col("event_id").alias("key"), body.alias("value"), F.lit("rejected").alias("reason")))
    heads = F.array_join(F.transform(F.coalesce("headers", F.array().cast(good.schema["headers"].dataType)), lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return good.union(dead).select("key", "value", heads.alias("headers"))


@query("SELECT event_id, round(value / 2, 6) AS score FROM events")
def stream_redelivery(spark, d):
    """A batch whose write fails isn't committed: the restarted stream delivers it again, once."""
    src, out = new_path(spark, "redelivered"), new_path(spark, "delivered")
    load(spark, d, "events", ["event_id", "value"]).write.parquet(src)
    failures = [True]

    def run(batch, batch_id):
        batch.select("event_id", (F.col("value") / 2).alias("score")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if failures:
            failures.pop()
            raise RuntimeError("not confirmed")

    for _ in range(2):
        try:
            scoring.start_scoring(scoring.file_stream(spark, src, "event_id bigint, value double"), f"{out}-checkpoint", run).awaitTermination()
        except Exception as error:
            if "not confirmed" not in str(error):
                raise
    return spark.read.parquet(out).select("event_id", r6("score"))


@query("SELECT event_id::VARCHAR AS transaction_id, round(value, 6) AS score FROM events WHERE event_id % 7 <> 0")
def inference_log(spark, d):
    """Scored rows with an id; a folder that can't be written costs nothing."""
    e = load(spark, d, "events", ["event_id", "value"])
    rows = e.select(F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("transaction_id"), F.col("value").alias("score"))
    path, blocked = new_path(spark, "inference"), os.path.join(driver_folder(spark), "file")
    write_json({}, blocked)
    if scoring.log_inference(rows, blocked, 0) or not scoring.log_inference(rows, path, 0):
        raise RuntimeError("a log that can't be written must be told apart")
    return spark.read.parquet(path).select("transaction_id", r6("score"))


# -- Contracts and guards

_RAW_SQL = """(SELECT CASE WHEN event_id % 97 = 0 THEN (event_id - 1)::VARCHAR WHEN event_id % 89 = 0 THEN 'x' ELSE event_id::VARCHAR END AS id, CASE WHEN event_id % 31 = 0 THEN '2' WHEN event_id % 37 = 0 THEN NULL ELSE '0' END AS label,
 CASE WHEN event_id % 41 = 0 THEN '0' ELSE '5' END AS dt, CASE WHEN event_id % 43 = 0 THEN '-1.5' WHEN event_id % 47 = 0 THEN 'abc' ELSE value::VARCHAR END AS amt, CASE WHEN event_id % 53 = 0 THEN 'Z' WHEN event_id % 59 = 0 THEN NULL ELSE 'W' END AS product FROM events)"""


@query(f"""WITH r AS (SELECT try_cast(id AS BIGINT) AS i, id, label::BIGINT AS label, label AS l, dt::BIGINT AS dt, try_cast(amt AS DOUBLE) AS a, amt, product FROM {_RAW_SQL}),
k(rule, bad) AS (SELECT 'type:TransactionID', i IS NULL FROM r UNION ALL SELECT 'type:TransactionAmt', a IS NULL FROM r UNION ALL SELECT 'null:TransactionID', i IS NULL FROM r UNION ALL SELECT 'null:isFraud', label IS NULL FROM r
 UNION ALL SELECT 'null:TransactionAmt', a IS NULL FROM r UNION ALL SELECT 'null:ProductCD', product IS NULL FROM r UNION ALL SELECT 'label_binary', coalesce(label NOT IN (0, 1), false) FROM r UNION ALL SELECT 'id_not_negative', coalesce(i < 0, false) FROM r UNION ALL SELECT 'time_positive', dt <= 0 FROM r
 UNION ALL SELECT 'amount_positive', coalesce(a <= 0, false) FROM r UNION ALL SELECT 'product_known', coalesce(product NOT IN ('W', 'H', 'C', 'S', 'R'), false) FROM r
 UNION ALL SELECT 'unique:TransactionID', i IN (SELECT i FROM r WHERE i IS NOT NULL GROUP BY i HAVING count(*) > 1) FROM r)
SELECT rule, count(*) FILTER (bad) AS failures FROM k GROUP BY rule HAVING count(*) FILTER (bad) > 0""")
def raw_schema_report(spark, d):
    """The pinned schema of raw transactions over rows with wrong types, missing values, bad values and repeated ids; rules that fail."""
    i = F.col("event_id")
    e = load(spark, d, "events", ["event_id", "value"])
    raw = e.select(
        F.when(i % 97 == 0, (i - 1).cast("string")).when(i % 89 == 0, "x").otherwise(i.cast("string")).alias("TransactionID"), F.when(i % 31 == 0, "2").when(i % 37 == 0, None).otherwise("0").alias("isFraud"),
        F.when(i % 41 == 0, "0").otherwise("5").alias("TransactionDT"), F.when(i % 43 == 0, "-1.5").when(i % 47 == 0, "abc").otherwise(F.col("value").cast("string")).alias("TransactionAmt"),
        F.when(i % 53 == 0, "Z").when(i % 59 == 0, None).otherwise("W").alias("ProductCD"), *[F.lit(None).cast("string").alias(c) for c, (_, may_lack) in prepare.TRANSACTION_COLUMNS.items() if may_lack],
    )
    return prepare.schema_report(raw, prepare.TRANSACTION_COLUMNS, prepare.transaction_rules(), "TransactionID").where("failures > 0")


@query("SELECT 'null:TransactionID' AS rule, count(*) FILTER (doc_id % 50 = 0) AS failures FROM labels UNION ALL SELECT 'id_not_negative', count(*) FILTER (doc_id % 50 = 1) FROM labels")
def identity_schema_report(spark, d):
    i = F.col("doc_id")
    ids = load(spark, d, "labels", ["doc_id"]).select(F.when(i % 50 == 1, -i).when(i % 50 != 0, i).alias("TransactionID"))
    return prepare.schema_report(ids, prepare.IDENTITY_COLUMNS, prepare.identity_rules(), "TransactionID").where("rule in ('null:TransactionID', 'id_not_negative')")


def _fails(f) -> str:
    try:
        f()
    except (ValueError, KeyError, RuntimeError, TypeError) as error:
        return type(error).__name__
    return "ok"


def _provenance(**info):
    return model.Bundle("linear", ["a"], {}, None, info=info)


def _champion(spark, tags):
    r = Registry(driver_folder(spark))
    v = r.add_version("run", tags)
    r.set_alias("champion", v)
    return r


_GUARDS = {
    "contract_has_all_columns": "ok", "contract_lacks_a_column": "KeyError", "same_features": "ok", "other_features": "ValueError", "costs_not_negative": "ok", "a_negative_cost": "ValueError",
    "ramp_default": "ok", "ramp_empty": "ValueError", "ramp_falls": "ValueError", "ramp_repeats": "ValueError", "ramp_from_zero": "ValueError", "ramp_above_one": "ValueError",
    "split_known": "ok", "split_unknown": "ValueError", "params_defaults": "ok", "params_unknown_key": "TypeError", "params_out_of_range": "ValueError", "params_no_training_rows": "ValueError",
    "columns_apart": "ok", "columns_on_both_sides": "ValueError", "champion_with_metrics": "ok", "champion_without_metrics": "ValueError", "champion_not_finite": "ValueError",
    "provenance_same": "ok", "provenance_differs": "ValueError", "labels_binary": "ok", "labels_of_two": "ValueError", "scores_not_finite": "ValueError", "enough_per_class": "ok", "too_few_per_class": "ValueError",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _GUARDS.items()) + ") t(guard, outcome)")
def guards(spark, d):
    """What each guard does with a good and a bad case."""
    e = load(spark, d, "events", ["event_id", "value"]).withColumn("label", (F.col("event_id") % 50 == 0).cast("int"))
    scored = e.select("label", (F.col("value") / 1000).alias("score"))
    cases = {
        "contract_has_all_columns": lambda: require_columns(e, ["event_id", "value"]), "contract_lacks_a_column": lambda: prepare.select_contract(e, ["event_id", "amt_log"], "label"),
        "same_features": lambda: same_features(["b", "a"], ["a", "b"]), "other_features": lambda: same_features(["a"], ["a", "b"]), "costs_not_negative": lambda: CostMatrix(0, 0), "a_negative_cost": lambda: CostMatrix(1, -1),
        "ramp_default": CanaryParams, "ramp_empty": lambda: CanaryParams(()), "ramp_falls": lambda: CanaryParams((0.5, 0.25)), "ramp_repeats": lambda: CanaryParams((0.1, 0.1)), "ramp_from_zero": lambda: CanaryParams((0, 1)), "ramp_above_one": lambda: CanaryParams((0.5, 1.5)),
        "split_known": lambda: prepare.check_split_name("holdout"), "split_unknown": lambda: prepare.check_split_name("dev"), "params_defaults": lambda: Params.from_dict({"monitor": {"psi": 0.3}}), "params_unknown_key": lambda: Params.from_dict({"monitor": {"psy": 0.3}}),
        "params_out_of_range": lambda: Params.from_dict({"canary": {"min_auprc_ratio": 1.5}}), "params_no_training_rows": lambda: Params.from_dict({"split": {"val": 0.4, "test": 0.4, "holdout": 0.4}}),
        "columns_apart": lambda: prepare.append_columns(e, "event_id", e.select("event_id", F.lit(1).alias("x"))), "columns_on_both_sides": lambda: prepare.append_columns(e, "event_id", e),
        "champion_with_metrics": lambda: _champion(spark, {"auprc": "0.5", "cost": "1.25"}).champion_metrics(), "champion_without_metrics": lambda: _champion(spark, {}).champion_metrics(), "champion_not_finite": lambda: _champion(spark, {"auprc": "nan", "cost": "1"}).champion_metrics(),
        "provenance_same": lambda: model.check_provenance(_provenance(rows=5), {"rows": 5}), "provenance_differs": lambda: model.check_provenance(_provenance(rows=5), {"rows": 6}),
        "labels_binary": lambda: metrics.require_binary(scored), "labels_of_two": lambda: metrics.require_binary(scored.withColumn("label", F.lit(2))), "scores_not_finite": lambda: metrics.require_binary(scored.withColumn("score", F.lit(float("nan")))),
        "enough_per_class": lambda: prepare.require_enough_per_class(e, "label", 5), "too_few_per_class": lambda: prepare.require_enough_per_class(e.where("label = 0 or event_id = 0"), "label", 5),
    }
    return spark.createDataFrame([(name, _fails(f)) for name, f in cases.items()], "guard string, outcome string")


#: Published defaults, written out for the comparison.
_DEFAULTS = {
    "alert_budget": 0.1, "auprc_tolerance": 0, "canary.max_error_rate": 0.001, "canary.max_holds": 3, "canary.max_p99_s": 0.05, "canary.min_agreement": 0.95, "canary.min_auprc_ratio": 0.98, "canary.min_samples": 500,
    "cost.false_negative": 100, "cost.false_positive": 5, "cost_tolerance": 0, "folds": 5, "monitor.auprc_floor": 0.3, "monitor.clock_skew_s": 300, "monitor.cooldown_s": 3600, "monitor.debounce": 3, "monitor.max_ids": 200000,
    "monitor.min_current": 500, "monitor.min_matched": 200, "monitor.psi": 0.2, "monitor.recompute_s": 15, "monitor.retention_s": 1800, "monitor.top_n": 15, "monitor.window": 5000, "recall_floor": 0.1, "replay.jitter": 0.2,
    "replay.label_lag_days": 7, "replay.max_wait_s": 2, "replay.warp": 2000, "seed": 42, "selection.max_correlation": 0.85, "selection.max_features": 30, "selection.max_missing": 0.9, "selection.min_periods": 1000,
    "selection.sample_rows": 100000, "smoothing": 20, "split.holdout": 0.15, "split.test": 0.15, "split.val": 0.15, "timeout_s": 3600, "trials": 50,
}


@query("SELECT name, value::DOUBLE AS value FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _DEFAULTS.items()) + ") t(name, value)")
def params_defaults(spark, d):
    """The parameters as they come from a file that only names its sections."""
    path = os.path.join(driver_folder(spark), "params.json")
    write_json({"split": {}, "monitor": {"psi": 0.2}, "recall_ks": [0.005, 0.01, 0.05]}, path)
    rows = []
    for name, value in asdict(Params.load(path)).items():
        rows += [(f"{name}.{k}", float(v)) for k, v in value.items() if not isinstance(v, (list, tuple))] if isinstance(value, dict) else [(name, float(value))] if not isinstance(value, (list, tuple)) else []
    return spark.createDataFrame(rows, "name string, value double")


@query(f"""SELECT category, count(*) AS n, round(avg(CASE WHEN label = 1 AND score < 0.5 THEN 100.0::DOUBLE WHEN label = 0 AND score >= 0.5 THEN 7.0::DOUBLE ELSE 0 END), 6) AS cost_per_row, count(*) >= 200 AS enough
FROM {TRANSACTIONS_SQL} GROUP BY category""")
def params_costs(spark, d):
    """Costs of decisions by category, priced by parameters from a file: what it names is taken from there, the rest are defaults."""
    path = os.path.join(driver_folder(spark), "params.json")
    write_json({"cost": {"false_positive": 7}, "monitor": {"psi": 0.3}}, path)
    params = Params.load(path)
    hit, y = F.col("score") >= 0.5, F.col("label") == 1
    cost = F.when(y & ~hit, F.lit(float(params.cost.false_negative))).when(~y & hit, F.lit(float(params.cost.false_positive))).otherwise(0.0)
    per = transactions(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.avg(cost).alias("cost_per_row"))
    return rounded(per.withColumn("enough", F.col("n") >= params.monitor.min_matched))


_ENCODED_SQL = f"(SELECT category, substr(category, 1, 1) AS initial, label FROM {TRANSACTIONS_SQL})"


@query(f"""WITH t AS {_ENCODED_SQL}, a AS (SELECT count(*)::DOUBLE AS n, avg(label) AS prior FROM t),
c AS (SELECT count(*) AS k, (sum(label) + 20 * any_value(prior)) / (count(*) + 20) AS y, any_value(a.n) AS n FROM t, a GROUP BY category),
i AS (SELECT count(*) AS k, (sum(label) + 20 * any_value(prior)) / (count(*) + 20) AS y, any_value(a.n) AS n FROM t, a GROUP BY initial)
SELECT 0::BIGINT AS position, 'category_freq' AS name, round(sum(k * k / n) / any_value(n), 4) AS mean FROM c UNION ALL SELECT 1, 'category_target', round(sum(k * y) / any_value(n), 4) FROM c
UNION ALL SELECT 2, 'initial_freq', round(sum(k * k / n) / any_value(n), 4) FROM i UNION ALL SELECT 3, 'initial_target', round(sum(k * y) / any_value(n), 4) FROM i""")
def encoded_names(spark, d):
    """The encoded columns of a table in the order of the contract's names, with the mean of each."""
    columns = ["category", "initial"]
    t = transactions(spark, d).select("id", "category", F.substring("category", 1, 1).alias("initial"), "label")
    encoder, prior = encode.fit_encoder(t, columns, "label")
    names = encoded_feature_names(columns)
    means = encode.transform_encoder(t, encoder, prior, columns, "id").select(*names).agg(*[F.round(F.avg(c), 4).alias(c) for c in names])
    return means.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("mean")) for c in names])).alias("position", "x")).select(F.col("position").cast("bigint").alias("position"), "x.name", "x.mean")


_WIDTHS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS type, round(sum({c})::DOUBLE, 0) AS total FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey")
)


@query(_WIDTHS)
def downcast(spark, d):
    """Each column's smallest type, and its total after the cast."""
    names = ["l_orderkey", "l_partkey", "l_suppkey"]
    small = prepare.downcast(load(spark, d, "lineitem", names))
    kinds = dict(small.dtypes)
    totals = small.agg(*[F.sum(c).cast("double").alias(c) for c in names])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.round(c, 0).alias("total")) for c in names])).alias("x")).select("x.*")


@query(f"SELECT a.id, a.label::BIGINT AS label, round(b.V1, 6) AS V1, round(b.V1 * 2, 6) AS twice FROM {wide_block_sql(2)} a JOIN {wide_block_sql(2)} b USING (id)")
def append_columns(spark, d):
    b = wide_block(spark, d, 2)
    return rounded(prepare.append_columns(b.select("id", "label"), "id", b.select("id", "V1", (F.col("V1") * 2).alias("twice"))))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def input_example(spark, d):
    return prepare.input_example(load(spark, d, "orders", ["o_orderkey", "o_orderstatus"]), "o_orderkey")


@query(f"SELECT category, round(v, 6) AS auprc FROM (SELECT category, CASE WHEN category = 'error' THEN NULL ELSE avg(score) END AS v FROM {TRANSACTIONS_SQL} GROUP BY category) ORDER BY coalesce(v, '-inf'::DOUBLE) DESC, category LIMIT 1")
def pick_primary(spark, d):
    c = transactions(spark, d).groupBy("category").agg(F.avg("score").alias("a")).select("category", F.when(F.col("category") == "error", float("nan")).otherwise(F.col("a")).alias("auprc"))
    return model.pick_rows(c, "auprc", "category").select("category", r6("auprc"))


# -- Column functions


@query(f"SELECT id, CASE WHEN id % 3 = 0 OR us / 1e6 > 1e9 + 300 + id THEN 12345.0::DOUBLE ELSE round(us / 1e6::DOUBLE, 3) END AS at FROM {TRANSACTIONS_SQL}")
def event_time(spark, d):
    """Publish time, or the join clock where it is missing or too far ahead."""
    t = transactions(spark, d)
    published = F.when(F.col("id") % 3 != 0, F.col("us") / F.lit(1e6))
    return t.select("id", F.round(S.event_time_seconds(published, F.lit(1e9) + F.col("id"), F.lit(12345.0), 300.0), 3).alias("at"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN round(value, 6) ELSE 0.5 END AS x FROM events")
def safe_float(spark, d):
    i = F.col("event_id") % 5
    text = F.when(i == 0, "n/a").when(i == 1, "nan").when(i == 2, "1e999").when(i == 3, F.col("value").cast("string")).otherwise("0.5")
    return load(spark, d, "events", ["event_id", "value"]).select("event_id", F.round(S.safe_float(text), 6).alias("x"))


@query("SELECT event_id, printf('%.6f', value) AS tag, round(value, 6) AS served FROM events")
def tag_format(spark, d):
    """Values as six-decimal tags, and what a reader of the tag serves with."""
    tag = S.six_decimals(F.col("value"))
    return load(spark, d, "events", ["event_id", "value"]).select("event_id", tag.alias("tag"), S.safe_float(tag).alias("served"))


@query("SELECT event_id, least(30.0::DOUBLE, 0.5::DOUBLE * 2 ** (event_id % 12)) AS delay_s FROM events")
def backoff(spark, d):
    return load(spark, d, "events", ["event_id"]).select("event_id", S.backoff_column(F.col("event_id") % 12).alias("delay_s"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(spark, d):
    return load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("sha256"))


_HEADER = "CASE event_id % 6 WHEN 0 THEN (event_id % 40)::VARCHAR WHEN 1 THEN '-3' WHEN 2 THEN strftime(TIMESTAMP '2024-05-01 12:00:00' + to_seconds(event_id % 90 - 20), '%a, %d %b %Y %H:%M:%S GMT') WHEN 3 THEN 'soon' WHEN 4 THEN '1.5' END"


@query(f"""SELECT event_id, CASE WHEN w IS NULL THEN 0.5::DOUBLE ELSE least(greatest(w, 0.5::DOUBLE), 30.0::DOUBLE) END AS wait_s FROM (SELECT event_id,
 CASE event_id % 6 WHEN 0 THEN (event_id % 40)::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN greatest(0, event_id % 90 - 20)::DOUBLE WHEN 4 THEN 1.5 END AS w FROM events)""")
def retry_after(spark, d):
    """The wait after a throttled call, by headers in seconds, as dates, malformed and missing."""
    i = F.col("event_id")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + i % 90 - 20), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(i % 6 == 0, (i % 40).cast("string")).when(i % 6 == 1, "-3").when(i % 6 == 2, date).when(i % 6 == 3, "soon").when(i % 6 == 4, "1.5")
    return load(spark, d, "events", ["event_id"]).select(i, scoring.shed_delay_s(header, now).alias("wait_s"))


# -- Monitoring and serving


@query(f"SELECT id, round(score, 6) AS score FROM {TRANSACTIONS_SQL} ORDER BY us DESC, id DESC LIMIT 250")
def feature_window(spark, d):
    """The last scored rows, as there are enough of them."""
    t = transactions(spark, d).select(F.struct("us", "id").alias("seq"), "id", "score")
    return matching.feature_window(t, 250, 200).select("id", r6("score"))


@query(f"SELECT id, CASE WHEN id % 4 <> 0 THEN round(greatest(0, 1.7e9::DOUBLE - us / 1e6), 3) END AS lag_s FROM {TRANSACTIONS_SQL}")
def clock_lag(spark, d):
    clock = F.when(F.col("id") % 4 != 0, F.col("us") / F.lit(1e6))
    return transactions(spark, d).select("id", F.round(monitor.clock_lag(F.lit(1.7e9), clock), 3).alias("lag_s"))


@query(f"""WITH RECURSIVE e AS (SELECT us / 1e6::DOUBLE AS t FROM {TRANSACTIONS_SQL} WHERE category = 'error' AND label = 1),
f AS (SELECT min(t) AS t FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t - f.t >= 100000) FROM f WHERE f.t IS NOT NULL)
SELECT round(t, 3) AS at_s FROM f WHERE t IS NOT NULL""")
def retrain_dispatch(spark, d):
    """Alerts of any kind dispatch a retraining at most once in a cooldown."""
    alerts = transactions(spark, d).where("category = 'error' and label = 1").select((F.col("us") / F.lit(1e6)).alias("at_s"))
    return scoring.retrain_times(alerts, 100_000).select(F.round("at_s", 3).alias("at_s"))


@query(f"""WITH t AS (SELECT id, category, label FROM {TRANSACTIONS_SQL}), m AS (SELECT category, count(*) AS n, sum(label) AS s FROM t GROUP BY category), a AS (SELECT count(*)::DOUBLE AS n, avg(label) AS p FROM t)
SELECT id, round(m.n / a.n, 5) AS category_freq, round((m.s + 20 * a.p) / (m.n + 20), 5) AS category_target FROM (SELECT * FROM t ORDER BY {S.hash_u32_sql(42, 'id')}, id LIMIT 300) JOIN m USING (category), a""")
def drift_baseline(spark, d):
    """A bounded sample under the encoding of all training rows."""
    t = transactions(spark, d).select("id", "category", "label")
    table, prior = encode.fit_encoder(t, ["category"], "label")
    out = serving.drift_baseline(t, table, prior, ["category"], "id", rows=300)
    return out.select("id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("category_freq", "category_target")])


@query(f"""WITH t AS (SELECT * FROM {TRANSACTIONS_SQL}), v AS (SELECT card, count(*)::DOUBLE AS n, sum(amount) AS s FROM t WHERE card % 3 <> 0 GROUP BY card),
m AS (SELECT category, count(*) AS n, sum(label) AS s FROM t WHERE category <> 'purchase' GROUP BY category), a AS (SELECT sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM m)
SELECT id::VARCHAR AS transaction_id, round(coalesce(v.n, 0), 3) AS card_txn_count_24h, -1.0::DOUBLE AS seconds_since_prev_txn, round(coalesce(t.amount / (v.s / v.n), 1), 3) AS amt_to_card_mean_24h, round(ln(1 + t.amount), 3) AS amt_log,
 CASE WHEN id % 4 <> 0 THEN round(t.amount, 3) END AS V1, round(coalesce(m.n / a.n, 0), 3) AS "ProductCD_freq", round(coalesce((m.s + 20 * a.s / a.n) / (m.n + 20), a.s / a.n), 3) AS "ProductCD_target"
FROM t LEFT JOIN v USING (card) LEFT JOIN m USING (category), a""")
def assemble_features(spark, d):
    """Contract rows of scoring requests: maps reindexed, latest velocity or its fills, on-demand features, encodings."""
    t = transactions(spark, d)
    rows = t.withColumns({"V1": F.when(F.col("id") % 4 != 0, F.col("amount")), "V9": F.col("amount"), "ProductCD": F.col("category")})
    raw = prepare.raw_attributes(rows, ["V1", "V9"], ["ProductCD"])
    requests = rows.select(F.col("id").cast("string").alias("transaction_id"), F.col("card").cast("string").alias("card_id"), "amount", raw.alias("raw"))
    per = t.where("card % 3 <> 0").groupBy(F.col("card").cast("string").alias("card_id")).agg(F.count("*").cast("double").alias("card_txn_count_24h"), F.sum("amount").alias("card_amt_sum_24h"), F.avg("amount").alias("card_amt_mean_24h"), F.max("amount").alias("card_amt_max_24h"), F.lit(None).cast("double").alias("seconds_since_prev_txn"))
    table, prior = encode.fit_encoder(t.where("category <> 'purchase'").select(F.col("category").alias("ProductCD"), "label"), ["ProductCD"], "label")
    out = serving.assemble_features(requests, per, table, prior, ["V1"])
    names = ["card_txn_count_24h", "seconds_since_prev_txn", "amt_to_card_mean_24h", "amt_log", "V1", "ProductCD_freq", "ProductCD_target"]
    return out.select("transaction_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in names])


@query(f"""WITH m AS (SELECT *, lag(us) OVER (PARTITION BY card ORDER BY us, id) AS prev FROM {TRANSACTIONS_SQL})
SELECT id, count(amount) OVER f AS n, round(coalesce(sum(amount) OVER f, 0)::FLOAT::DOUBLE, 2) AS total, round(coalesce(max(amount) OVER f, 0)::FLOAT::DOUBLE, 2) AS largest, round(coalesce((us - prev) / 1e6::DOUBLE, -1)::FLOAT::DOUBLE, 2) AS gap_s
FROM m WINDOW f AS (PARTITION BY card ORDER BY us RANGE BETWEEN {velocity.DAY_US} PRECEDING AND 1 PRECEDING)""")
def velocity_view(spark, d):
    """The card feature view of clean transactions."""
    t = transactions(spark, d).select(F.col("card").cast("string").alias("card_id"), F.col("ts").alias("event_timestamp"), F.col("id").alias("TransactionID"), F.col("amount").alias("TransactionAmt"))
    v = serving.velocity_view(t)
    cents = lambda c, n: F.round(F.col(c).cast("double"), 2).alias(n)
    return v.select(F.col("TransactionID").alias("id"), big("card_txn_count_24h", "n"), cents("card_amt_sum_24h", "total"), cents("card_amt_max_24h", "largest"), cents("seconds_since_prev_txn", "gap_s"))
