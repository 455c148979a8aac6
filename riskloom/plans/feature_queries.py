"""Queries over features, joins, preparation and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.contract import TRANSACTION_EVENT, VELOCITY_FILLS
from riskloom.functions import scalars as S
from riskloom.operators import encode, prepare, velocity
from riskloom.plans.registry import big, query, r6, rounded
from riskloom.sources.tables import ORDERS_SQL, TRANSACTIONS_SQL, load, matching_columns, order_transactions, transactions, wide_block, wide_block_sql, written

YEAR_US = 365 * velocity.DAY_US
COLUMNS = ["category", "label_text"]


def _velocity_sql(table: str, window_us: int) -> str:
    frame = f"OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {window_us} PRECEDING AND 1 PRECEDING)"
    return f"""SELECT id, count(amount) {frame} AS v_count, round(coalesce(sum(amount) {frame}, 0), 6) AS v_sum,
 round(coalesce(avg(amount) {frame}, 0), 6) AS v_mean, round(coalesce(max(amount) {frame}, 0), 6) AS v_max FROM {table}"""


def _velocity(df, window_us):
    parts = 1 if window_us == velocity.DAY_US else 16  # a year is most of the history: a frequent card would be one task
    return velocity.velocity(df, window_us=window_us, parts=parts).select("id", "v_count", r6("v_sum"), r6("v_mean"), r6("v_max"))


@query(_velocity_sql(TRANSACTIONS_SQL, velocity.DAY_US))
def velocity_24h(spark, d):
    return _velocity(transactions(spark, d), velocity.DAY_US)


@query(_velocity_sql(ORDERS_SQL, YEAR_US))
def velocity_ties_365d(spark, d):
    return _velocity(order_transactions(spark, d), YEAR_US)


@query(f"SELECT id, round(coalesce((us - lag(us) OVER (PARTITION BY card ORDER BY us, id)) / 1e6::DOUBLE, -1), 6) AS gap_s FROM {ORDERS_SQL}")
def seconds_since_prev(spark, d):
    return velocity.seconds_since_previous(order_transactions(spark, d)).select("id", r6("gap_s"))


@query(f"""WITH v AS ({_velocity_sql(TRANSACTIONS_SQL, velocity.DAY_US)}),
g AS (SELECT id, amount, coalesce((us - lag(us) OVER (PARTITION BY card ORDER BY us, id)) / 1e6::DOUBLE, -1) AS gap_s FROM {TRANSACTIONS_SQL}),
x AS (SELECT *, avg(amount) OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {velocity.DAY_US} PRECEDING AND 1 PRECEDING) AS m FROM {TRANSACTIONS_SQL})
SELECT id, v_count, v_sum, v_mean, v_max, round(gap_s, 6) AS gap_s, round(ln(1 + g.amount), 6) AS amt_log,
 round(coalesce(g.amount / nullif(coalesce(m, 0), 0), 1), 6) AS amt_ratio FROM v JOIN g USING (id) JOIN (SELECT id, m FROM x) USING (id)""")
def feature_row(spark, d):
    df = velocity.seconds_since_previous(velocity.velocity(transactions(spark, d)))
    ratio = S.amount_to_mean_ratio(F.col("amount"), F.col("v_mean"))
    return df.select("id", "v_count", r6("v_sum"), r6("v_mean"), r6("v_max"), r6("gap_s"), r6(S.amount_log(F.col("amount")), "amt_log"), r6(ratio, "amt_ratio"))


@query(f"SELECT card, id, us, round(amount, 6) AS amount FROM {ORDERS_SQL} QUALIFY row_number() OVER (PARTITION BY card ORDER BY us DESC, id DESC) = 1")
def latest_per_card(spark, d):
    return velocity.latest_per_card(order_transactions(spark, d).select("card", "id", "us", "amount")).select("card", "id", "us", r6("amount"))


def _asof(spark, d, **options):
    tx = transactions(spark, d)
    right = tx.where("category = 'click'").select("card", "us", F.col("id").alias("rid"), F.col("amount").alias("ramount"))
    return velocity.asof_join(tx.where("category = 'purchase'").select("id", "card", "us"), right, by="card", us="us", right_tie="rid", values=["rid", "ramount"], **options)


_ASOF_SQL = f"""FROM (SELECT * FROM {TRANSACTIONS_SQL} WHERE category = 'purchase') l
 ASOF LEFT JOIN (SELECT id AS rid, card, us, amount AS ramount FROM {TRANSACTIONS_SQL} WHERE category = 'click') r ON l.card = r.card AND l.us >= r.us"""


@query(f"SELECT l.id, r.rid, round(r.ramount, 6) AS ramount, r.us AS matched_us {_ASOF_SQL}")
def asof_backward(spark, d):
    return _asof(spark, d).select("id", "rid", r6("ramount"), "matched_us")


@query(f"SELECT l.id, CASE WHEN l.us - r.us <= {velocity.DAY_US} THEN r.rid END AS rid, CASE WHEN l.us - r.us <= {velocity.DAY_US} THEN round(r.ramount, 6) END AS ramount {_ASOF_SQL}")
def asof_ttl(spark, d):
    return _asof(spark, d, tolerance_us=velocity.DAY_US).select("id", "rid", r6("ramount"))


@query(f"""WITH o AS (SELECT id, card, o.us, o.amount FROM {ORDERS_SQL} o),
r AS (SELECT card, us, max(id) AS rid FROM o WHERE id % 3 = 0 GROUP BY card, us)
SELECT l.id, r.rid FROM (SELECT * FROM o WHERE id % 3 <> 0) l ASOF LEFT JOIN r ON l.card = r.card AND l.us >= r.us""")
def asof_ties(spark, d):
    o = order_transactions(spark, d)
    right = o.where("id % 3 = 0").select("card", "us", F.col("id").alias("rid"))
    return velocity.asof_join(o.where("id % 3 <> 0").select("id", "card", "us"), right, by="card", us="us", right_tie="rid", values=["rid"], width_us=90 * velocity.DAY_US).select("id", "rid")


@query(f"""SELECT c.c_custkey AS card, coalesce(n, 0)::DOUBLE AS card_txn_count_24h, round(coalesce(a, 0), 6) AS card_amt_sum_24h, -1.0::DOUBLE AS seconds_since_prev_txn
FROM customer c LEFT JOIN (SELECT card, count(*) AS n, max(amount) AS a FROM {ORDERS_SQL} GROUP BY card) s ON s.card = c.c_custkey""")
def online_lookup_default(spark, d):
    o = order_transactions(spark, d)
    snapshot = o.groupBy("card").agg(F.count("*").cast("double").alias("card_txn_count_24h"), F.max("amount").alias("card_amt_sum_24h"), F.lit(None).cast("double").alias("seconds_since_prev_txn"))
    fills = {c: VELOCITY_FILLS[c] for c in ("card_txn_count_24h", "card_amt_sum_24h", "seconds_since_prev_txn")}
    return velocity.lookup_latest(load(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("card")), snapshot, card="card", fills=fills).select("card", "card_txn_count_24h", r6("card_amt_sum_24h"), "seconds_since_prev_txn")


@query(f"SELECT min(ts) AS start, max(ts) + INTERVAL 1 SECOND AS \"end\" FROM {TRANSACTIONS_SQL}")
def materialization_bounds(spark, d):
    return velocity.materialization_bounds(transactions(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query("SELECT d.doc_id, d.source, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_1to1(spark, d):
    docs, marks = load(spark, d, "documents", ["doc_id", "source"]), load(spark, d, "labels", ["doc_id", "quality"])
    return rounded(prepare.merge_one_to_one(docs, marks, "doc_id").select("doc_id", "source", "quality"))


@query("SELECT l_orderkey * 100 + l_linenumber AS key, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_key_report(spark, d):
    df = load(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("key"))
    return prepare.duplicate_keys(df, "key")


@query("""SELECT 'key_not_negative' AS rule, count(*) FILTER (NOT coalesce(o_orderkey >= 0, false)) AS failures FROM orders
UNION ALL SELECT 'status_known', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
UNION ALL SELECT 'price_above_1000', count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) FROM orders
UNION ALL SELECT 'priority_urgent_or_high', count(*) FILTER (NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)) FROM orders""")
def validation_report(spark, d):
    c = F.col
    rules = {"key_not_negative": c("o_orderkey") >= 0, "status_known": c("o_orderstatus").isin("F", "O"), "price_above_1000": c("o_totalprice") > 1000, "priority_urgent_or_high": c("o_orderpriority").isin("1-URGENT", "2-HIGH")}
    return prepare.validation_report(load(spark, d, "orders"), rules)


@query(f"SELECT round(avg(label), 6) AS rate, avg(label) BETWEEN 0.005 AND 0.15 AS passed FROM {TRANSACTIONS_SQL}")
def label_rate_gate(spark, d):
    return prepare.label_rate_gate(transactions(spark, d), "label").select(r6("rate"), "passed")


_PAYLOAD_SQL = """(SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN '{"broken": '
 ELSE '{"transaction_id":"' || CASE WHEN event_id % 29 = 0 THEN '' ELSE event_id::VARCHAR END || '","card_id":"' || user_id::VARCHAR || '","amount":' || CASE WHEN event_id % 31 = 0 THEN '-1.0' ELSE value::VARCHAR END || '}' END AS payload, event_id, value FROM events)"""


@query(f"""SELECT event_id, CASE WHEN payload IS NULL OR payload = '' THEN 'empty_payload' WHEN event_id % 23 = 0 THEN 'deserialize_error'
 WHEN event_id % 29 = 0 OR event_id % 31 = 0 OR NOT (value > 0 AND value <= 1e6) THEN 'rejected' END AS reason FROM {_PAYLOAD_SQL}""")
def event_contract_dlq(spark, d):
    e = load(spark, d, "events", ["event_id", "user_id", "value"])
    i = F.col("event_id")
    event = F.to_json(F.struct(F.when(i % 29 == 0, "").otherwise(i.cast("string")).alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), F.when(i % 31 == 0, -1.0).otherwise(F.col("value")).alias("amount")))
    payload = F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, F.lit("")).when(i % 23 == 0, F.lit('{"broken": ')).otherwise(event)
    parsed = e.select(i, payload.alias("payload")).withColumn("e", F.from_json("payload", "transaction_id string, card_id string, amount double, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("event_id", prepare.event_reason(F.col("e.amount"), F.col("e.transaction_id"), F.col("e.card_id"), F.col("e._corrupt").isNotNull(), F.col("payload")).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, concat_ws('_', l_partkey::VARCHAR, CASE WHEN l_suppkey % 5 = 0 THEN 'na' ELSE l_suppkey::VARCHAR END, l_linenumber::VARCHAR, l_quantity::BIGINT::VARCHAR) AS card_id,
 TIMESTAMP '2017-12-01 00:00:00' + to_seconds(l_orderkey) AS event_ts FROM lineitem""")
def card_id_and_event_ts(spark, d):
    df = load(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    key = S.make_card_id(["l_partkey", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")), "l_linenumber", "l_quantity"])
    return df.select("l_orderkey", big("l_linenumber"), "l_partkey", key.alias("card_id"), S.to_event_timestamp(F.col("l_orderkey")).cast("timestamp_ntz").alias("event_ts"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE round(value::FLOAT::DOUBLE, 3) END AS x FROM events""")
def coerce_numeric(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "x1").when(F.col("event_id") % 7 == 0, "1e300").otherwise(F.col("value").cast("string"))
    return load(spark, d, "events", ["event_id", "value"]).select("event_id", F.round(S.coerce_numeric(raw).cast("double"), 3).alias("x"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity::BIGINT::VARCHAR AS number_key, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR ELSE l_returnflag END AS text_key FROM lineitem")
def as_keys(spark, d):
    df = load(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"])
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))).otherwise(F.col("l_returnflag"))
    return df.select("l_orderkey", big("l_linenumber"), "l_partkey", S.number_key(F.col("l_quantity")).alias("number_key"), S.text_key(text).alias("text_key"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS DOUBLE) AS k, NULL::DOUBLE AS absent FROM events")
def map_reindex(spark, d):
    df = load(spark, d, "events", ["event_id", "props"]).withColumn("m", F.from_json("props", "map<string,double>"))
    return df.select("event_id", *S.reindex_map(S.finite_values(F.col("m")), ["k", "absent"]))


_SPLIT_SQL = f"""(SELECT id, us, CASE WHEN r <= n - floor(n * 0.15::DOUBLE) * 3 THEN 'train' WHEN r <= n - floor(n * 0.15::DOUBLE) * 2 THEN 'val' WHEN r <= n - floor(n * 0.15::DOUBLE) THEN 'test' ELSE 'holdout' END AS split
 FROM (SELECT id, us, row_number() OVER (ORDER BY us, id) AS r, count(*) OVER () AS n FROM {TRANSACTIONS_SQL}))"""


def _split(spark, d):
    return prepare.time_split(transactions(spark, d).select("id", "us", "label", "score"), key="us", tie="id", val=0.15, test=0.15, holdout=0.15)


@query(f"SELECT id, split FROM {_SPLIT_SQL}")
def time_split(spark, d):
    return _split(spark, d).select("id", "split")


@query(f"SELECT split, count(*) AS n, min(us) AS first, max(us) AS last, true AS chronological FROM {_SPLIT_SQL} GROUP BY split")
def split_bounds(spark, d):
    return prepare.split_bounds(_split(spark, d), "us")


@query(f"""SELECT id, label::BIGINT AS label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {S.hash_u32_sql(42, "id")}, id) AS r, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM {TRANSACTIONS_SQL})
WHERE r <= round_even(c * (500::DOUBLE / n), 0)""")
def stratified_sample(spark, d):
    return rounded(prepare.stratified_sample(transactions(spark, d).select("id", "label"), size=500, label="label", id="id"))


@query(f"SELECT id FROM {TRANSACTIONS_SQL} ORDER BY {S.hash_u32_sql(7, 'id')}, id LIMIT 300")
def uniform_sample(spark, d):
    return prepare.uniform_sample(transactions(spark, d).select("id"), 300, "id", seed=7)


def _folds_sql(k: int, seed: int) -> str:
    return f"(SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {S.hash_u32_sql(seed, 'id')}, id) - 1) % {k} AS fold FROM {TRANSACTIONS_SQL})"


@query(f"SELECT id, fold::BIGINT AS fold FROM {_folds_sql(5, 42)}")
def stratified_folds(spark, d):
    return rounded(prepare.stratified_folds(transactions(spark, d).select("id", "label"), k=5, label="label", id="id").select("id", "fold"))


@query(f"SELECT id, fold::BIGINT AS half FROM {_folds_sql(2, 9)} WHERE id IN (SELECT id FROM {_SPLIT_SQL} WHERE split = 'val') AND false UNION ALL "
       f"SELECT id, ((row_number() OVER (PARTITION BY label ORDER BY {S.hash_u32_sql(9, 'id')}, id) - 1) % 2)::BIGINT FROM {TRANSACTIONS_SQL} JOIN (SELECT id FROM {_SPLIT_SQL} WHERE split = 'val') USING (id)")
def val_halves(spark, d):
    val = _split(spark, d).where("split = 'val'").select("id", "label")
    return prepare.stratified_folds(val, k=2, label="label", id="id", seed=9).select("id", big("fold", "half"))


_CATS = ["l_returnflag", "l_linestatus", "l_quantity"]
_CATS_SQL = """(SELECT 'l_returnflag' AS "column", CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_returnflag END AS key, (l_discount > 0.05::DOUBLE)::INT AS y FROM lineitem
 UNION ALL SELECT 'l_linestatus', l_linestatus, (l_discount > 0.05::DOUBLE)::INT FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity::BIGINT::VARCHAR, (l_discount > 0.05::DOUBLE)::INT FROM lineitem)"""
_TOTALS_SQL = "(SELECT count(*)::DOUBLE AS total, avg((l_discount > 0.05::DOUBLE)::INT) AS prior FROM lineitem)"


def _categorical(spark, d):
    df = load(spark, d, "lineitem", ["l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"])
    return df.select(F.when(F.col("l_partkey") % 10 != 0, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_quantity", (F.col("l_discount") > 0.05).cast("int").alias("y"))


@query(f'SELECT "column", key, round(count(*) / any_value(total), 6) AS freq FROM {_CATS_SQL}, {_TOTALS_SQL} GROUP BY 1, 2')
def freq_encode(spark, d):
    return rounded(encode.frequency_map(_categorical(spark, d), _CATS))


@query(f'SELECT "column", key, round(count(*) / any_value(total), 6) AS freq, round((sum(y) + 20 * any_value(prior)) / (count(*) + 20), 6) AS target FROM {_CATS_SQL}, {_TOTALS_SQL} GROUP BY 1, 2')
def target_encode(spark, d):
    return rounded(encode.fit_encoder(_categorical(spark, d), _CATS, "y")[0])


@query(f"""WITH t AS (SELECT id, category, label FROM {TRANSACTIONS_SQL}), f AS (SELECT category, count(*) AS n, sum(label) AS s FROM t WHERE category <> 'purchase' GROUP BY category),
a AS (SELECT sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM f)
SELECT id, round(coalesce(f.n / a.n, 0), 5) AS category_freq, round(coalesce((f.s + 20 * a.s / a.n) / (f.n + 20), a.s / a.n), 5) AS category_target FROM t LEFT JOIN f USING (category), a""")
def encode_transform(spark, d):
    t = transactions(spark, d).select("id", "category", "label")
    table, prior = encode.fit_encoder(t.where("category <> 'purchase'"), ["category"], "label")
    out = encode.transform_encoder(t, table, prior, ["category"], "id")
    return out.select("id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("category_freq", "category_target")])


@query(f"""WITH t AS (SELECT id, category AS key, label, fold FROM {_folds_sql(5, 42)}), k AS (SELECT DISTINCT key, fold FROM t),
o AS (SELECT k.key, k.fold, count(t.id) FILTER (t.key = k.key) AS n, coalesce(sum(t.label) FILTER (t.key = k.key), 0) AS s, avg(t.label) AS prior FROM k JOIN t ON t.fold <> k.fold GROUP BY k.key, k.fold)
SELECT id, 'category' AS "column", round(CASE WHEN n > 0 THEN (s + 20 * prior) / (n + 20) ELSE prior END, 6) AS target_oof FROM t JOIN o USING (key, fold)""")
def oof_target(spark, d):
    t = written(prepare.stratified_folds(transactions(spark, d).select("id", "category", "label"), k=5, label="label", id="id"), "folds")  # read by three aggregations
    return rounded(encode.oof_targets(t, ["category"], "label", "fold", "id"))


@query("SELECT 'V' || i AS name FROM generate_series(1, 64) t(i) WHERE false UNION ALL SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem) WHERE regexp_full_match(column_name, 'l_.*key')")
def schema_columns(spark, d):
    return spark.createDataFrame([(c,) for c in matching_columns(spark, f"{d}/lineitem.parquet", "l_.*key")], "name string")


@query(f"SELECT id, label::BIGINT AS label, round(V1, 6) AS V1, round(V3, 6) AS V3 FROM {wide_block_sql(4)}")
def contract_projection(spark, d):
    out = prepare.select_contract(wide_block(spark, d, 4), ["id", "V1", "V3"], "label")
    return rounded(out)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0.0::DOUBLE ELSE round(value::FLOAT::DOUBLE, 3) END AS card_amt_sum_24h, CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE round((value / 2)::FLOAT::DOUBLE, 3) END AS seconds_since_prev_txn FROM events")
def fill_missing_velocity(spark, d):
    v, i = F.col("value"), F.col("event_id")
    df = load(spark, d, "events", ["event_id", "value"]).select(i, F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, float("nan")).otherwise(v).alias("card_amt_sum_24h"), F.when(i % 3 == 0, float("inf")).otherwise(v / 2).alias("seconds_since_prev_txn"))
    return S.fill_missing_velocity(df).select("event_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("card_amt_sum_24h", "seconds_since_prev_txn")])


@query("""SELECT event_id, event_id::VARCHAR AS transaction_id, round(value, 6) AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS event_timestamp,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) END AS v1, event_type AS product FROM events""")
def event_json_roundtrip(spark, d):
    """Encode transactions with their nested attributes as JSON and decode them again."""
    e = load(spark, d, "events").withColumns({"V1": F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")), "ProductCD": F.col("event_type")})
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamp = F.regexp_replace(stamp, "Z$", "+00:00")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), F.col("value").alias("amount"), stamp.alias("event_timestamp"), prepare.raw_attributes(e, ["V1"], ["ProductCD"]).alias("raw")))
    back = e.select("event_id", F.from_json(body, TRANSACTION_EVENT).alias("t"))
    return back.select("event_id", "t.transaction_id", r6("t.amount", "amount"), "t.event_timestamp", r6(F.col("t.raw.v")["V1"], "v1"), F.col("t.raw.categorical")["ProductCD"].alias("product"))
