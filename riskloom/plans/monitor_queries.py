"""Queries over replay, monitoring, rules, canary and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.contract import CanaryParams, CostMatrix, MonitorParams, ReplayParams
from riskloom.functions.ordering import ranked, running
from riskloom.functions.scalars import hash_u32, hash_u32_sql
from riskloom.operators import drift, prepare, rules
from riskloom.plans.registry import query, r6, rounded
from riskloom.session import SETTINGS
from riskloom.sources.tables import TRANSACTIONS_SQL, load, new_path, transactions, written
from riskloom.streaming import matching, monitor, online, replay, scoring

R = 1800.0
_DELAYS = f"(SELECT id, us, coalesce(least(greatest((us - lag(us) OVER (ORDER BY us, id)) / 1e6::DOUBLE / 2000, 0), 0.1::DOUBLE), 0) AS delay_s FROM {TRANSACTIONS_SQL})"


@query(f"SELECT id, round(delay_s, 6) AS delay_s FROM {_DELAYS}")
def replay_delays(spark, d):
    return replay.replay_delays(transactions(spark, d).select("id", "us"), max_wait_s=0.1).select("id", r6("delay_s"))


@query(f"""SELECT id, round(sum(delay_s) OVER (ORDER BY us, id) + 7.0::DOUBLE * 86400 / 2000 * (0.8::DOUBLE + 0.4::DOUBLE * ({hash_u32_sql(42, 'id')} / 4294967296.0::DOUBLE)), 4) AS label_offset_s FROM {_DELAYS}""")
def label_schedule(spark, d):
    out = replay.label_schedule(transactions(spark, d).select("id", "us"), ReplayParams(max_wait_s=0.1))
    return out.select("id", F.round("label_offset_s", 4).alias("label_offset_s"))


@query(f"""WITH o AS (SELECT id, sum(delay_s) OVER (ORDER BY us, id) AS offset_s FROM {_DELAYS}) SELECT id, ceil(offset_s / (SELECT ceil(max(offset_s) * 1000 / 8) / 1000 FROM o))::BIGINT AS tick FROM o""")
def paced_replay(spark, d):
    """The tick, of eight over the whole replay, in which each event is published."""
    schedule = replay.by_offset(replay.emission_offsets(transactions(spark, d).select("id", "card", "us"), max_wait_s=0.1))
    tick_s = math.ceil(schedule.agg(F.max("offset_s")).first()[0] * 1000 / 8) / 1000
    path = new_path(spark, "replay")
    run = replay.Replay(schedule, path)
    run.finish(run.start(replay.step_clock(spark, tick_s), f"{path}-checkpoint"))
    return spark.read.schema("id bigint, batch bigint").parquet(f"{path}/events").select("id", F.col("batch").alias("tick"))


def _arrivals(spark, d):
    """Scores and labels of all events: labels come early, late, twice or never; some ids come back later."""
    t = transactions(spark, d).withColumn("h", hash_u32(3, F.col("id")))
    at, no = F.col("us") / F.lit(1e6), lambda kind: F.lit(None).cast(kind)
    decided = lambda x: F.when(F.col("h") % 2 == 0, x >= 0.5).otherwise(x >= 0.4)  # noqa: E731  the threshold has changed within the window
    one = F.round("score", 3)
    score = t.select(F.col("id").cast("string").alias("id"), at.alias("arrival"), at.alias("t"), one.alias("score"), decided(one).alias("decision"), no("int").alias("label"))
    late = at + F.pmod("h", F.lit(3000)) - 500
    label = t.where("h % 10 < 7").select(F.col("id").cast("string").alias("id"), late.alias("arrival"), (late - F.when(F.col("h") % 7 == 0, 4000.0).otherwise(0.0)).alias("t"), no("double").alias("score"), no("boolean").alias("decision"), F.col("label"))
    again = label.where("cast(id as bigint) % 5 = 0").withColumns({"arrival": F.col("arrival") + 100, "t": F.col("t") + 100})
    back = t.where("id % 11 = 0")
    back_label = back.select(F.col("id").cast("string").alias("id"), (at + 5000).alias("arrival"), (at + 5000).alias("t"), no("double").alias("score"), no("boolean").alias("decision"), (1 - F.col("label")).alias("label"))
    half = F.round(F.col("score") / 2, 3)
    back_score = back.select(F.col("id").cast("string").alias("id"), (at + 5300).alias("arrival"), (at + 5300).alias("t"), half.alias("score"), decided(half).alias("decision"), no("int").alias("label"))
    every = written(score.union(label).union(again).union(back_label).union(back_score), "arrivals")
    return written(ranked(every, "arrival", ["id", "score", "t"], "seq").select("seq", "id", "t", "score", "decision", "label"), "arrivals")


_DECIDED = "CASE WHEN h % 2 = 0 THEN {0} >= 0.5::DOUBLE ELSE {0} >= 0.4::DOUBLE END"
_ARRIVALS = f"""RECURSIVE t AS (SELECT *, {hash_u32_sql(3, 'id')} AS h, us / 1e6::DOUBLE AS ev, round(score, 3) AS one, round(score / 2, 3) AS half FROM {TRANSACTIONS_SQL}),
l AS (SELECT id::VARCHAR AS id, ev + h % 3000 - 500 AS arrival, ev + h % 3000 - 500 - CASE WHEN h % 7 = 0 THEN 4000.0::DOUBLE ELSE 0.0::DOUBLE END AS t, NULL::DOUBLE AS score, NULL::BOOLEAN AS decision, label FROM t WHERE h % 10 < 7),
a AS (SELECT id::VARCHAR AS id, ev AS arrival, ev AS t, one AS score, {_DECIDED.format('one')} AS decision, NULL::INT AS label FROM t UNION ALL SELECT * FROM l
 UNION ALL SELECT id, arrival + 100, t + 100, score, decision, label FROM l WHERE id::BIGINT % 5 = 0
 UNION ALL SELECT id::VARCHAR, ev + 5000, ev + 5000, NULL, NULL, 1 - label FROM t WHERE id % 11 = 0 UNION ALL SELECT id::VARCHAR, ev + 5300, ev + 5300, half, {_DECIDED.format('half')}, NULL FROM t WHERE id % 11 = 0),
s AS (SELECT *, row_number() OVER (ORDER BY arrival, id, score NULLS FIRST, t) AS seq FROM a),
h AS (SELECT *, max(t) OVER (ORDER BY seq) AS clock FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM h WHERE t >= clock - {R}),
f AS (SELECT id, 0::BIGINT AS rn, NULL::DOUBLE AS ps, NULL::BOOLEAN AS pd, NULL::INT AS pl, NULL::DOUBLE AS pt, NULL::BIGINT AS pq, NULL::DOUBLE AS closed, NULL::DOUBLE AS ms, NULL::BOOLEAN AS md, NULL::INT AS ml, NULL::BIGINT AS mq FROM (SELECT DISTINCT id FROM k)
 UNION ALL SELECT id, rn, CASE WHEN shut THEN ps WHEN NOT hit THEN score END, CASE WHEN shut THEN pd WHEN NOT hit THEN decision END, CASE WHEN shut THEN pl WHEN NOT hit THEN label END, CASE WHEN shut THEN pt WHEN NOT hit THEN t END,
  CASE WHEN shut THEN pq WHEN NOT hit THEN seq END, CASE WHEN NOT shut AND hit THEN t ELSE closed END, CASE WHEN NOT shut AND hit THEN coalesce(score, ps) END, CASE WHEN NOT shut AND hit THEN CASE WHEN score IS NOT NULL THEN decision ELSE pd END END,
  CASE WHEN NOT shut AND hit THEN coalesce(label, pl) END, CASE WHEN NOT shut AND hit THEN seq END
 FROM (SELECT k.*, f.ps, f.pd, f.pl, f.pt, f.pq, f.closed, coalesce(f.closed >= k.clock - {R}, false) AS shut,
  coalesce(f.pt >= k.clock - {R}, false) AND ((f.ps IS NOT NULL AND k.label IS NOT NULL) OR (f.pl IS NOT NULL AND k.score IS NOT NULL)) AS hit FROM f JOIN k ON k.id = f.id AND k.rn = f.rn + 1)),
matches AS (SELECT id, ms AS score, md AS decision, ml AS label, mq AS matched_seq FROM f WHERE mq IS NOT NULL),
open AS (SELECT CASE WHEN ps IS NOT NULL THEN 'pending' ELSE 'early' END AS side, id, pq AS seq FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1) WHERE pt >= (SELECT max(t) FROM s) - {R})"""


@query(f"WITH {_ARRIVALS} SELECT id, score, decision, label::BIGINT AS label, matched_seq FROM matches")
def score_label_join(spark, d):
    return rounded(matching.match_batch(_arrivals(spark, d), R))


@query(f"WITH {_ARRIVALS} SELECT (SELECT count(*) FROM matches) AS matched, (SELECT count(*) FROM open WHERE side = 'pending') AS pending")
def match_counts(spark, d):
    return rounded(matching.match_counts(_arrivals(spark, d), R))


@query(f"WITH {_ARRIVALS.replace(f'- {R}', '- 400000.0')} SELECT side, id, seq FROM open QUALIFY row_number() OVER (PARTITION BY side ORDER BY seq DESC) <= 4")
def state_cap(spark, d):
    """What waits after the last arrival, the newest four of each side."""
    return matching.waiting(_arrivals(spark, d), 400_000.0, max_ids=4)


@query(f"""WITH {_ARRIVALS}, n AS (SELECT * FROM matches ORDER BY matched_seq DESC LIMIT 300),
c AS (SELECT score, count(*) AS c, sum(label) AS p FROM n GROUP BY score), g AS (SELECT p, sum(p) OVER w AS cp, sum(c) OVER w AS cn FROM c WINDOW w AS (ORDER BY score DESC))
SELECT count(*) AS matched, (SELECT round(sum(p * cp / cn) / sum(p), 6) FROM g) AS auprc,
 round(avg(CASE WHEN label = 1 AND NOT decision THEN 100.0::DOUBLE WHEN label = 0 AND decision THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS cost, round(avg(decision::INT), 6) AS flagged_rate FROM n""")
def rolling_metrics(spark, d):
    return rounded(matching.rolling_metrics(matching.match_batch(_arrivals(spark, d), R), CostMatrix(), window=300))


_CYCLES = f"""(SELECT cycle, CASE WHEN cycle % 11 <> 0 THEN round(avg(amount) / 500, 6) END AS max_psi, round(avg(score), 6) AS auprc, count(*) AS matched FROM
 (SELECT *, us // 21600000000 AS cycle FROM {TRANSACTIONS_SQL}) GROUP BY cycle)"""


def _cycles(spark, d):
    t = transactions(spark, d).withColumn("cycle", F.expr("us div 21600000000"))
    return t.groupBy("cycle").agg(F.round(F.avg("amount") / 500, 6).alias("p"), F.round(F.avg("score"), 6).alias("auprc"), F.count("*").alias("matched")).select("cycle", F.when(F.col("cycle") % 11 != 0, F.col("p")).alias("max_psi"), "auprc", "matched")


_PSI_LIMIT, _FLOOR = 0.1, 0.47


def _latch_sql(source: str, breached: str) -> str:
    return f"""(SELECT *, b AND sum(b::INT) OVER (PARTITION BY isl ORDER BY cycle) = 2 AS fires FROM (SELECT *, sum((NOT b)::INT) OVER (ORDER BY cycle) AS isl FROM (SELECT *, {breached} AS b FROM {source}) WHERE b IS NOT NULL))"""


@query(f"SELECT cycle, fires FROM {_latch_sql(_CYCLES, f'max_psi > {_PSI_LIMIT}')} UNION ALL SELECT cycle, false FROM {_CYCLES} WHERE max_psi IS NULL")
def breach_latch(spark, d):
    return drift.breach_latch(_cycles(spark, d), order="cycle", breached=F.col("max_psi") > _PSI_LIMIT, required=2).select("cycle", "fires")


@query(f"""SELECT cycle, 'data_drift' AS kind, 'feature_drift_psi' AS metric, max_psi AS value, {_PSI_LIMIT}::DOUBLE AS threshold FROM {_latch_sql(_CYCLES, f'max_psi > {_PSI_LIMIT}')} WHERE fires
UNION ALL SELECT cycle, 'concept_drift', 'rolling_auprc', auprc, {_FLOOR}::DOUBLE FROM {_latch_sql(_CYCLES, f'auprc < {_FLOOR} AND matched >= 60')} WHERE fires""")
def drift_alerts(spark, d):
    return rounded(scoring.alerts(_cycles(spark, d), MonitorParams(psi=_PSI_LIMIT, auprc_floor=_FLOOR, debounce=2, min_matched=60)))


@query(f"""WITH RECURSIVE e AS (SELECT card, us / 1e6::DOUBLE AS t FROM {TRANSACTIONS_SQL} WHERE category = 'error'),
f AS (SELECT card, min(t) AS t FROM e GROUP BY card UNION ALL SELECT f.card, (SELECT min(e.t) FROM e WHERE e.card = f.card AND e.t - f.t >= 200000) FROM f WHERE f.t IS NOT NULL)
SELECT card, count(*) AS fires, round(min(t), 3) AS first, round(max(t), 3) AS last FROM f WHERE t IS NOT NULL GROUP BY card""")
def cooldown(spark, d):
    e = transactions(spark, d).where("category = 'error'").select("card", (F.col("us") / F.lit(1e6)).alias("t"))
    out = drift.cooldown(e, by="card", at_s="t", seconds=200000)
    return out.groupBy("card").agg(F.count("*").alias("fires"), F.round(F.min("t"), 3).alias("first"), F.round(F.max("t"), 3).alias("last"))


@query(f"SELECT id, max(card) OVER (ORDER BY us, id) AS version_max FROM {TRANSACTIONS_SQL}")
def model_version_max(spark, d):
    t = transactions(spark, d)
    return running(t.select("id", "us", F.col("card").alias("version_max")), "us", ["id"], {"version_max": F.col("version_max")}, how="max").select("id", "version_max")


@query(f"""WITH o AS (SELECT card, quantile_cont(amount, 0.99) / 10000 AS p99_s, avg((amount > 140)::INT) / 100 AS error_rate, count(*) AS samples, avg((score > 0.5)::INT) AS agreement,
 CASE WHEN card % 4 <> 0 THEN avg(score) * 2 END AS auprc_ratio, card % 3 = 0 AS final FROM {TRANSACTIONS_SQL} GROUP BY card)
SELECT card, CASE WHEN p99_s > 0.03 OR error_rate > 0.004 THEN 'rollback' WHEN samples < 60 THEN 'hold' WHEN agreement < 0.42 OR coalesce(auprc_ratio < 0.9, false) THEN 'rollback' WHEN final AND auprc_ratio IS NULL THEN 'hold' ELSE 'promote' END AS decision FROM o""")
def canary_step(spark, d):
    t = transactions(spark, d)
    o = t.groupBy("card").agg((F.percentile("amount", 0.99) / 10000).alias("p99_s"), (F.avg((F.col("amount") > 140).cast("int")) / 100).alias("error_rate"), F.count("*").alias("samples"), F.avg((F.col("score") > 0.5).cast("int")).alias("agreement"), (F.avg("score") * 2).alias("r"))
    o = o.select("*", F.when(F.col("card") % 4 != 0, F.col("r")).alias("auprc_ratio"), (F.col("card") % 3 == 0).alias("final"))
    p = CanaryParams(max_p99_s=0.03, max_error_rate=0.004, min_samples=60, min_agreement=0.42, min_auprc_ratio=0.9)
    return o.select("card", rules.canary_decision(p).alias("decision"))


# Counters from the events: per user, a count that restarts every five days.
_COUNTER = f"(SELECT card, us // 1000000 AS ts_s, id, row_number() OVER (PARTITION BY card, us // 432000000000 ORDER BY us, id)::DOUBLE AS value, (category = 'error')::INT::DOUBLE AS bad FROM {TRANSACTIONS_SQL})"


def _counter(spark, d):
    t = transactions(spark, d).select("card", F.expr("us div 1000000").alias("ts_s"), "us", "id", (F.col("category") == "error").cast("double").alias("bad"), F.expr("us div 432000000000").alias("era"))
    return ranked(t, "us", ["id"], "value", groups=["card", "era"]).withColumn("value", F.col("value").cast("double")).drop("era", "us")


_STEP = f"(SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY card ORDER BY ts_s, id) AS prev FROM {_COUNTER}))"


@query(f"SELECT id, round(sum(step) OVER w, 6) AS increase, round((sum(step) OVER w) / 86400.0::DOUBLE, 6) AS rate FROM {_STEP} WINDOW w AS (PARTITION BY card ORDER BY ts_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)")
def rate_increase(spark, d):
    out = rules.increase(_counter(spark, d).withColumn("o", F.struct("ts_s", "id")), ["card"], 86400)
    return out.select("id", r6("increase"), r6(F.col("increase") / 86400.0, "rate"))


_BURN = f"""(SELECT *, coalesce(lr > 0.05 AND sr > 0.05, false) AS burning FROM (SELECT card, id, ts_s, sum(bad) OVER l / sum(1.0::DOUBLE) OVER l AS lr, sum(bad) OVER s / sum(1.0::DOUBLE) OVER s AS sr FROM {_COUNTER}
 WINDOW l AS (PARTITION BY card ORDER BY ts_s RANGE BETWEEN 863999 PRECEDING AND CURRENT ROW), s AS (PARTITION BY card ORDER BY ts_s RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW)))"""


def _burning(spark, d):
    c = _counter(spark, d).withColumn("total", F.lit(1.0))
    return rules.burn(c, bad="bad", total="total", order="ts_s", by=["card"], limit=0.05, long_s=864000, short_s=172800)


@query(f"SELECT id, round(lr, 6) AS long_ratio, round(sr, 6) AS short_ratio, burning FROM {_BURN}")
def burn_rate(spark, d):
    return _burning(spark, d).select("id", r6("long_ratio"), r6("short_ratio"), "burning")


@query(f"""SELECT id, burning AND ts_s - min(CASE WHEN burning THEN ts_s END) OVER (PARTITION BY card, run) >= 3600 AS firing FROM
 (SELECT *, sum((NOT burning)::INT) OVER (PARTITION BY card ORDER BY ts_s, id) AS run FROM {_BURN})""")
def alert_for(spark, d):
    return rules.persists(_burning(spark, d), active="burning", order="ts_s", by=["card"], for_s=3600).select("id", "firing")


_BOUNDS = (10.0, 25.0, 50.0, 100.0, 200.0)


@query(f"""WITH b AS (SELECT card, le, count(*) FILTER (amount <= le) AS c FROM {TRANSACTIONS_SQL}, (SELECT unnest([{', '.join(map(str, _BOUNDS))}, 'inf'::DOUBLE]) AS le) GROUP BY card, le),
p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY card) AS total FROM b WINDOW w AS (PARTITION BY card ORDER BY le)),
h AS (SELECT * FROM p WHERE c >= total * 0.95::DOUBLE QUALIFY row_number() OVER (PARTITION BY card ORDER BY le) = 1)
SELECT card, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (total * 0.95::DOUBLE - below) / (c - below) END, 6) AS quantile FROM h""")
def latency_quantile(spark, d):
    t = transactions(spark, d).select("card", "amount", F.explode(F.array(*map(F.lit, [*_BOUNDS, float("inf")]))).alias("le"))
    b = t.groupBy("card", "le").agg(F.count_if(F.col("amount") <= F.col("le")).alias("count"))
    return rounded(rules.histogram_quantile(b, ["card"], 0.95))


@query(f"""WITH a AS (SELECT card AS service, us // 86400000000 AS day, CASE WHEN category = 'error' THEN 'fast' WHEN category = 'purchase' THEN 'slow' ELSE 'other' END AS alertname FROM {TRANSACTIONS_SQL})
SELECT service, alertname, count(*) AS alerts FROM a WHERE NOT (alertname = 'slow' AND (service, day) IN (SELECT (service, day) FROM a WHERE alertname = 'fast')) GROUP BY 1, 2""")
def inhibition(spark, d):
    name = F.when(F.col("category") == "error", "fast").when(F.col("category") == "purchase", "slow").otherwise("other")
    a = transactions(spark, d).select(F.col("card").alias("service"), F.expr("us div 86400000000").alias("day"), name.alias("alertname"))
    return rules.grouped_alerts(rules.inhibit(a, "fast", "slow", ["service", "day"]))


@query("SELECT event_id, CASE WHEN s IS NULL OR s >= 500 OR s IN (401, 403) THEN 'unavailable' WHEN s = 429 THEN 'throttled' WHEN s BETWEEN 200 AND 299 THEN 'ok' ELSE 'rejected' END AS outcome FROM (SELECT event_id, [200, 204, 302, 400, 401, 403, 404, 429, 500, 503, NULL][1 + event_id % 11] AS s FROM events)")
def outcome_classes(spark, d):
    status = F.array(*[F.lit(s).cast("int") for s in (200, 204, 302, 400, 401, 403, 404, 429, 500, 503, None)])[F.col("event_id") % 11]
    return load(spark, d, "events", ["event_id"]).select("event_id", scoring.outcome(status).alias("outcome"))


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 5 = 4 THEN 'ignored' WHEN event_id % 17 = 0 OR (event_id % 2 = 1 AND event_id % 7 = 0) THEN 'poison' ELSE 'ok' END AS status,
 CASE WHEN event_id % 13 = 0 OR event_id % 5 = 4 OR event_id % 17 = 0 OR event_id % 2 = 1 THEN NULL ELSE round(value / (value + 50), 6) END AS score FROM events""")
def monitor_router(spark, d):
    i = F.col("event_id")
    scored = F.to_json(F.struct(i.cast("string").alias("transaction_id"), F.lit(1).alias("model_version"), (F.col("value") / (F.col("value") + 50)).alias("fraud_score"), F.lit(True).alias("decision")))
    label = F.to_json(F.struct(i.cast("string").alias("transaction_id"), F.when(i % 7 == 0, 2).otherwise(1).alias("is_fraud")))
    topic = F.when(i % 5 == 4, "other").when(i % 2 == 0, "scored-features").otherwise("labels")
    body = F.when(i % 13 == 0, F.lit(None)).when(i % 17 == 0, "{").when(i % 2 == 0, scored).otherwise(label)
    out = monitor.route(load(spark, d, "events", ["event_id", "value"]).select(i, topic.alias("topic"), body.alias("value")).select("topic", "value", "event_id").withColumn("topic", F.col("topic")))
    ids = load(spark, d, "events", ["event_id"])
    routed = out.where("status <> 'ignored' and id is not null").select(F.col("id").cast("bigint").alias("event_id"), "status", "score")
    lost = F.when((i % 13 == 0) | (i % 5 == 4), "ignored").otherwise("poison")
    return ids.join(routed, "event_id", "left").select("event_id", F.coalesce("status", lost).alias("status"), r6("score"))


@query(f"""SELECT cycle * 21600 AS ts_s, 'auprc' AS metric, auprc AS value FROM {_CYCLES} UNION ALL SELECT cycle * 21600, 'matched', matched::DOUBLE FROM {_CYCLES}
UNION ALL SELECT cycle * 21600, 'max_psi', max_psi FROM {_CYCLES} WHERE max_psi IS NOT NULL""")
def metric_rows(spark, d):
    cycles = _cycles(spark, d).withColumn("at", F.col("cycle") * 21600)
    return monitor.metric_rows(cycles, "at", ["auprc", "matched", "max_psi"]).select("ts_s", "metric", r6("value"))


@query(f"SELECT category, us // 86400000000 AS day, count(*) AS n, round(count(*) / 86400.0::DOUBLE, 6) AS per_s, round(sum((label = 1)::INT) / count(*) / 0.001::DOUBLE, 4) AS burn FROM {TRANSACTIONS_SQL} GROUP BY 1, 2")
def dashboard_rates(spark, d):
    t = transactions(spark, d).groupBy("category", F.expr("us div 86400000000").alias("day")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    return t.select("category", "day", "n", r6(F.col("n") / 86400.0, "per_s"), F.round(F.col("bad") / F.col("n") / 0.001, 4).alias("burn"))


@query("""WITH o AS (SELECT event_id, user_id, s = 503 AS bad FROM (SELECT *, [200, 503, 503, 503, 429, 503, 200][1 + (event_id // 3) % 7] AS s FROM events) WHERE s <> 429),
i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM o)
SELECT event_id, bad AND sum(bad::INT) OVER (PARTITION BY user_id, isl ORDER BY event_id) = 3 AS fires FROM i
UNION ALL SELECT event_id, false FROM (SELECT *, [200, 503, 503, 503, 429, 503, 200][1 + (event_id // 3) % 7] AS s FROM events) WHERE s = 429""")
def breaker_streaks(spark, d):
    status = F.array(*map(F.lit, (200, 503, 503, 503, 429, 503, 200)))[F.expr("cast(event_id div 3 % 7 as int)")]
    o = load(spark, d, "events", ["event_id", "user_id"]).withColumn("outcome", scoring.outcome(status))
    return scoring.breaker_trips(o, "event_id", by=["user_id"]).select("event_id", "fires")


@query(f"""SELECT round(quantile_cont(amount, 0.99) / 1000, 6) AS p99_s, round(avg((category = 'error')::INT), 6) AS error_rate, count(*) AS samples,
 round(avg(((score > 0.5) = (score > 0.45))::INT), 6) AS agreement FROM {TRANSACTIONS_SQL}""")
def canary_observation(spark, d):
    t = transactions(spark, d)
    canary = t.select("id", (F.col("amount") / 1000).alias("latency_s"), (F.col("category") == "error").alias("failed"), (F.col("score") > 0.5).alias("decision"))
    return rounded(rules.observation(t.select("id", (F.col("score") > 0.45).alias("decision")), canary))


@query(f"""WITH RECURSIVE r AS (SELECT card AS client, us / (1e6 * 50000)::DOUBLE AS t, row_number() OVER (PARTITION BY card ORDER BY us, id) AS n FROM {TRANSACTIONS_SQL}),
b AS (SELECT client, n, t, 4.0::DOUBLE AS tokens, true AS ok FROM r WHERE n = 1
 UNION ALL SELECT client, n, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT r.client, r.n, r.t, least(5.0::DOUBLE, b.tokens + (r.t - b.t) * 0.5::DOUBLE) AS have FROM b JOIN r ON r.client = b.client AND r.n = b.n + 1))
SELECT client, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS denied FROM b GROUP BY client""")
def token_bucket(spark, d):
    r = transactions(spark, d).select(F.col("card").alias("client"), (F.col("us") / F.lit(1e6 * 50_000)).alias("at_s"), "id")
    return rules.token_bucket(r, capacity=5, refill=0.5)


# -- Streams, run to their end over the same rows as a batch; the batch twin's SQL holds.


def _as_files(df) -> str:
    """Write rows where a file stream can read them."""
    path = new_path(df.sparkSession, "stream")
    df.write.parquet(path)
    return path


@query("""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'deserialize_error' WHEN event_id % 29 = 0 THEN 'rejected' END AS reason FROM events""")
def stream_dlq(spark, d):
    i = F.col("event_id")
    body = F.to_json(F.struct(F.when(i % 29 == 0, "").otherwise(i.cast("string")).alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), (F.col("value") + 1).alias("amount")))
    path = _as_files(load(spark, d, "events", ["event_id", "user_id", "value"]).select(i, F.when(i % 23 == 0, "{").otherwise(body).alias("value")))
    schema = "event_id bigint, value string"
    stream = scoring.file_stream(spark, path, schema)
    run = scoring.score_and_route(f"{path}-good", f"{path}-dead", lambda good: good.select("event_id", (F.col("event.amount") / (F.col("event.amount") + 50)).alias("score")))
    scoring.start_scoring(stream, f"{path}-checkpoint", run).awaitTermination()
    good = spark.read.parquet(f"{path}-good").select("event_id", F.lit(None).cast("string").alias("reason"))
    return good.union(spark.read.parquet(f"{path}-dead").select("event_id", "reason"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_velocity_parity(spark, d):
    """Daily totals per card by a windowed streaming aggregation."""
    path = _as_files(load(spark, d, "events", ["event_id", "user_id", "ts", "value"]))
    stream = scoring.file_stream(spark, path, "event_id bigint, user_id bigint, ts timestamp, value double").withWatermark("ts", "1 day")
    agg = stream.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    write = lambda b, _: b.write.mode("overwrite").parquet(f"{path}-out")
    agg.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}-out").select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", r6("total"))


@query(f"SELECT id::VARCHAR AS id, round(score, 3) AS score, score > 0.5 AS decision, label::BIGINT AS label FROM {TRANSACTIONS_SQL} WHERE category <> 'view'")
def stream_score_label_join(spark, d):
    t = transactions(spark, d)
    score = t.select((F.col("id") * 2).alias("seq"), F.col("id").cast("string").alias("id"), F.col("ts").alias("t"), F.round("score", 3).alias("score"), (F.col("score") > 0.5).alias("decision"), F.lit(None).cast("int").alias("label"))
    label = t.where("category <> 'view'").select((F.col("id") * 2 + 1).alias("seq"), F.col("id").cast("string").alias("id"), (F.col("ts") + F.expr("interval 60 seconds")).alias("t"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("decision"), "label")
    path = _as_files(score.union(label))
    stream = scoring.file_stream(spark, path, "seq bigint, id string, t timestamp, score double, decision boolean, label int")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    out = matching.match_stream(stream, R)
    query_ = out.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}-out/batch={i}")).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return rounded(spark.read.parquet(f"{path}-out").select("id", "score", "decision", "label"))


@query("SELECT o_orderkey AS key, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def order_key_duplicates(spark, d):
    return prepare.duplicate_keys(load(spark, d, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "key"), "key")


@query(f"""SELECT id, count(amount) OVER f AS v_count, round(coalesce(sum(amount) OVER f, 0), 6) AS v_sum, round(coalesce(avg(amount) OVER f, 0), 6) AS v_mean, round(coalesce(max(amount) OVER f, 0), 6) AS v_max
FROM {TRANSACTIONS_SQL} WINDOW f AS (PARTITION BY card ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)""")
def stream_velocity(spark, d):
    """The 24-hour look-back of every event on a stream, in three batches by time; the batch query's rows."""
    t = transactions(spark, d).select("id", "card", "us", "amount")
    path = new_path(spark, "stream")
    cuts = t.agg(F.percentile_approx("us", [0.33, 0.66], 1000)).first()[0] or []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = t.where((F.col("us") >= low) if low is not None else F.lit(True)).where((F.col("us") < high) if high is not None else F.lit(True))
        part.write.mode("append").parquet(path)
        out = online.velocity_stream(scoring.file_stream(spark, path, "id bigint, card bigint, us bigint, amount double", files_per_batch=1_000_000))  # a run takes all that is new at once
        run = out.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}-out/batch={i}")).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return rounded(spark.read.parquet(f"{path}-out").select("id", "v_count", "v_sum", "v_mean", "v_max"))


_LATE = 10_000_000_000  # arrivals of a cycle stand before those of the next


@query(f"""WITH n AS (SELECT max(id) + 1 AS n FROM {TRANSACTIONS_SQL}), ks AS (SELECT unnest(range(6)) AS cycle),
t AS (SELECT id, score, label, amount, id * 6 // n AS c FROM {TRANSACTIONS_SQL}, n),
m AS (SELECT score, label, score >= 0.5 AS hit, c + (id % 3 = 1)::INT AS k, (c + (id % 3 = 1)::INT) * {_LATE} + id * 4 + 1 AS seq FROM t WHERE id % 3 <> 0),
w AS (SELECT cycle, m.* FROM ks JOIN m ON k <= cycle QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY seq DESC) <= (SELECT n // 6 FROM n)),
r AS (SELECT cycle, count(*) AS matched, avg(CASE WHEN label = 1 AND NOT hit THEN 100.0::DOUBLE WHEN label = 0 AND hit THEN 5.0::DOUBLE ELSE 0 END) AS cost, avg(hit::INT) AS flagged_rate FROM w GROUP BY cycle),
g AS (SELECT cycle, p, sum(n) OVER o AS cum_n, sum(p) OVER o AS cum_p FROM (SELECT cycle, score, count(*) AS n, sum(label) AS p FROM w GROUP BY cycle, score) WINDOW o AS (PARTITION BY cycle ORDER BY score DESC)),
ap AS (SELECT cycle, sum(p * cum_p / cum_n) / sum(p) AS auprc FROM g GROUP BY cycle),
f AS (SELECT cycle, CASE WHEN c >= 3 THEN amount * 3 ELSE amount END AS a FROM ks JOIN t ON c <= cycle QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY c * {_LATE} + id * 4 DESC) <= (SELECT n // 6 FROM n)),
e AS (SELECT list_distinct(quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM t),
b AS (SELECT CASE WHEN amount IS NULL THEN -1 ELSE len([q FOR q IN edges IF q < amount]) END AS bin, count(*) AS nb FROM t, e GROUP BY 1),
fc AS (SELECT cycle, CASE WHEN a IS NULL THEN -1 ELSE len([q FOR q IN edges IF q < a]) END AS bin, count(*) AS nc FROM f, e GROUP BY 1, 2),
s AS (SELECT cycle, greatest(coalesce(nb, 0) / (SELECT sum(nb) FROM b), 0.0001::DOUBLE) AS x, greatest(coalesce(nc, 0) / sum(coalesce(nc, 0)) OVER (PARTITION BY cycle), 0.0001::DOUBLE) AS a
  FROM (SELECT cycle, bin FROM ks, b UNION SELECT cycle, bin FROM fc) LEFT JOIN b USING (bin) LEFT JOIN fc USING (cycle, bin)),
p AS (SELECT cycle, sum((a - x) * ln(a / x)) AS max_psi FROM s GROUP BY cycle),
z AS (SELECT cycle, matched, auprc, cost, flagged_rate, max_psi, max_psi > 0.2 AS drifted, auprc < 0.9 AND matched >= 100 AS weak, (SELECT count(*) FROM t WHERE c = cycle AND id % 5 = 0) AS poison FROM r JOIN ap USING (cycle) JOIN p USING (cycle))
SELECT cycle, matched, round(auprc, 6) AS auprc, round(cost, 6) AS cost, round(flagged_rate, 6) AS flagged_rate, round(max_psi, 6) AS max_psi, poison,
 concat_ws(',', CASE WHEN weak AND lag(weak) OVER o AND lag(weak, 2) OVER o AND NOT coalesce(lag(weak, 3) OVER o, false) THEN 'concept_drift' END,
  CASE WHEN drifted AND lag(drifted) OVER o AND lag(drifted, 2) OVER o AND NOT coalesce(lag(drifted, 3) OVER o, false) THEN 'data_drift' END) AS alerts FROM z WINDOW o AS (ORDER BY cycle)""")
def monitor_stream(spark, d):
    """Six cycles of the monitor over all events: scores, labels of which a third come a cycle later, poison, a feature that drifts from the fourth cycle on.

    Spark may add a batch without rows at the end, for timers; its cycle is left out.
    """
    t = transactions(spark, d)
    n = t.agg(F.max("id")).first()[0] + 1
    i, at, c = F.col("id"), F.col("us") / F.lit(1e6), F.floor(F.col("id") * 6 / n).cast("bigint")
    amount = F.when(c >= 3, F.col("amount") * 3).otherwise(F.col("amount"))
    scored = F.to_json(F.struct(i.cast("string").alias("transaction_id"), F.lit(1).alias("model_version"), F.col("score").alias("fraud_score"), (F.col("score") >= 0.5).alias("decision"), F.create_map(F.lit("amount"), amount).alias("features")))
    label = F.to_json(F.struct(i.cast("string").alias("transaction_id"), F.col("label").alias("is_fraud")))
    message = lambda cycle, nth, topic, value: F.struct(cycle.alias("cycle"), (cycle * _LATE + i * 4 + nth).alias("seq"), F.lit(topic).alias("topic"), value.alias("value"), at.alias("published_s"))
    late = c + F.when(i % 3 == 1, 1).otherwise(0)
    each = F.array(message(c, 0, "scored-features", scored), F.when(i % 3 != 0, message(late, 1, "labels", label)), F.when(i % 5 == 0, message(c, 2, "labels", F.lit("{"))))
    rows = written(t.select(F.explode(F.array_compact(each)).alias("m")).select("m.*"), "messages")
    path = new_path(spark, "stream")
    for cycle in range(6):
        rows.where(F.col("cycle") == cycle).drop("cycle").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    params = MonitorParams(retention_s=1e9, window=n // 6, min_current=100, min_matched=100, auprc_floor=0.9, max_ids=10**9)
    messages = scoring.file_stream(spark, path, "seq bigint, topic string, value string, published_s double", files_per_batch=1)
    online.start_monitor(messages, f"{path}-monitor", t.select("amount"), ["amount"], params, once=True).awaitTermination()
    fired = spark.read.parquet(f"{path}-monitor/alerts").groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("alerts"))
    cycles = spark.read.parquet(f"{path}-monitor/cycles").join(fired, "cycle", "left").withColumn("alerts", F.coalesce("alerts", F.lit("")))
    return rounded(cycles.where("cycle < 6").select("cycle", "matched", "auprc", "cost", "flagged_rate", "max_psi", "poison", "alerts"))
