"""Every alert rule evaluated over series made of the events; a second stands for 200. Each service has two series of a metric."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import rules
from riskloom.plans.registry import query
from riskloom.sources.tables import TRANSACTIONS_SQL, transactions, written

_BOUNDS = (0.5, 1.0, 2.0, float("inf"))
_ROWS = 150_000


def _label(rule: rules.Rule) -> dict[str, str]:
    return {k: v.split("|")[0].replace("..", "00") for k, v in rule.labels}


def _samples(t, metric, labels, value, *by):
    """A sample of a metric at each (service, endpoint, second) of ``t`` and further columns ``by``."""
    fixed = [x for k, v in labels.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))]
    return t.select("service", "ts_s", F.lit(metric).alias("metric"), F.create_map(*fixed, F.lit("endpoint"), F.col("endpoint")).alias("labels"), value.cast("double").alias("value"))


def _counter(per, *by):
    """Running counts of ``n``."""
    return per.withColumn("value", F.sum("n").over(Window.partitionBy("service", "endpoint", *by).orderBy("ts_s")))


def _under(rule: rules.Rule) -> str:
    return f"under_{rule.name}"


def _per_second(t):
    """A row for each (service, endpoint, second): all that the series of any rule are made of."""
    others = [r for r in rules.ALERT_RULES if r.kind == "quantile"]
    under = [F.array(*[F.count_if(F.col("amount") / 50 * r.limit <= F.lit(b * r.limit)) for b in _BOUNDS]).alias(_under(r)) for r in others]
    return t.groupBy("service", "endpoint", "ts_s").agg(
        F.count("*").alias("n"), F.count_if(F.col("category") == "error").alias("errors"), F.count_if(F.col("category").isNull()).alias("unknown"),
        F.count_if(F.col("category") == "purchase").alias("purchases"), F.count_if(F.col("category") != "view").alias("seen"),
        F.max("amount").alias("amount"), F.max(F.when(F.col("category") != "view", F.col("amount"))).alias("seen_amount"), *under,
    )


def _series(rule: rules.Rule, per):
    """Counters grow by what happened; gauges and latencies lie around the rule's limit."""
    at = ["service", "endpoint", "ts_s"]
    counted = lambda n: _counter(per.where(F.col(n) > 0).select(*at, F.col(n).alias("n")))
    if rule.name == "feature_fetch_errors":
        return _samples(counted("errors"), rule.metric, {}, F.col("value")).union(_samples(counted("n"), rule.of, {}, F.col("value") * 20))
    if rule.kind == "gauge":
        out = _samples(per, rule.metric, {}, F.col("amount") / 50 * rule.limit)
        if rule.name == "performance_decay":
            out = out.union(_samples(per.where("seen > 0"), "matched", {}, F.col("seen_amount") * 4))
        if rule.name == "join_clock_stalled":
            out = out.union(_samples(counted("purchases"), "scored", {}, F.col("value")))
        return out
    if rule.kind == "increase":
        return _samples(counted("n"), rule.metric, _label(rule), F.col("value") * max(1.0, rule.limit // 3))
    if rule.kind in ("ratio", "burn"):
        (name, bad), = _label(rule).items()
        kinds = {bad: F.col("errors"), "200": F.col("n") - F.col("errors") - F.col("unknown"), "unknown": F.col("unknown")}
        each = per.select(*at, F.explode(F.array(*[F.struct(F.lit(k).alias("status"), n.alias("n")) for k, n in kinds.items()])).alias("k")).select(*at, "k.*").where("n > 0")
        return _samples(_counter(each, "status"), rule.metric, {name: F.col("status")}, F.col("value"))
    each = F.array(*[F.struct(F.lit(b * rule.limit).alias("le"), F.col(_under(rule))[i].alias("n")) for i, b in enumerate(_BOUNDS)])
    return _samples(_counter(per.select(*at, F.explode(each).alias("k")).select(*at, "k.*"), "le"), rule.metric, {"le": F.col("le").cast("string")}, F.col("value"))


_T = f"(SELECT card::VARCHAR AS service, (id % 2)::VARCHAR AS endpoint, us // 200000000 AS ts_s, amount, category FROM {TRANSACTIONS_SQL})"


_T_BAD = f"(SELECT *, category = 'error' AS bad FROM {_T})"


def _frame(seconds: int, by: str = "service") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY ts_s RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"


def _steps_sql(where: str = "true", by: str = "", count: str = "count(*)", source: str = _T) -> str:
    """What each series grows by; the first sample of a series tells nothing."""
    series = f"service, endpoint{by}"
    return f"(SELECT {series}, ts_s, CASE WHEN row_number() OVER (PARTITION BY {series} ORDER BY ts_s) = 1 THEN 0 ELSE {count} END AS step FROM {source} WHERE {where} GROUP BY {series}, ts_s)"


def _gauge_sql(limit: float, fold: str) -> str:
    return f"SELECT service, ts_s, {fold}(v) AS value FROM (SELECT service, endpoint, ts_s, max(amount) / 50 * {limit}::DOUBLE AS v FROM {_T} GROUP BY ALL) GROUP BY 1, 2"


def _increase_sql(window_s: int, factor: float) -> str:
    return f"SELECT service, ts_s, sum(step * {factor}::DOUBLE) {_frame(window_s)} AS value FROM (SELECT service, ts_s, sum(step) AS step FROM {_steps_sql()} GROUP BY 1, 2)"


def _shares_sql(windows: tuple[int, ...]) -> str:
    per = f"SELECT service, ts_s, sum(step)::DOUBLE AS total, coalesce(sum(step) FILTER (bad), 0)::DOUBLE AS bad FROM {_steps_sql(by=', bad', source=_T_BAD)} GROUP BY 1, 2"
    share = ", ".join(f"sum(bad) {_frame(w)} / nullif(sum(total) {_frame(w)}, 0)" for w in windows)
    return f"SELECT service, ts_s, {f'least({share})' if len(windows) > 1 else share} AS value FROM ({per})"


def _quantile_sql(window_s: int, limit: float) -> str:
    les = ", ".join("'inf'::DOUBLE" if b == float("inf") else f"{b * limit}::DOUBLE" for b in _BOUNDS)
    source = f"(SELECT * FROM {_T}, (SELECT unnest([{les}]) AS le))"
    steps = _steps_sql(by=", le", count=f"count(*) FILTER (amount / 50 * {limit}::DOUBLE <= le)", source=source)
    grown = f"SELECT service, ts_s, le, sum(step) {_frame(window_s, 'service, le')} AS c FROM (SELECT service, ts_s, le, sum(step) AS step FROM {steps} GROUP BY 1, 2, 3)"
    placed = f"SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY service, ts_s) AS total FROM ({grown}) WINDOW w AS (PARTITION BY service, ts_s ORDER BY le)"
    hit = f"SELECT *, row_number() OVER (PARTITION BY service, ts_s ORDER BY le) AS k FROM ({placed}) WHERE total > 0 AND c >= total * 0.99::DOUBLE"
    value = "CASE WHEN isinf(le) THEN lo ELSE coalesce(lo + (le - lo) * (total * 0.99::DOUBLE - below) / nullif(c - below, 0), lo) END"
    return f"SELECT g.service, g.ts_s, {value} AS value FROM (SELECT DISTINCT service, ts_s FROM ({grown})) g LEFT JOIN (SELECT * FROM ({hit}) WHERE k = 1) h ON g.service = h.service AND g.ts_s = h.ts_s"


def _with_guard(value: str, guard: str) -> str:
    """The guard's last value counts for five minutes."""
    return f"SELECT v.service, v.ts_s, v.value, CASE WHEN v.ts_s - g.ts_s <= 300 THEN g.guard END AS guard FROM ({value}) v ASOF LEFT JOIN ({guard}) g ON v.service = g.service AND v.ts_s >= g.ts_s"


_FETCHES = f"SELECT service, ts_s, sum(step * 20.0::DOUBLE) AS total FROM {_steps_sql()} GROUP BY 1, 2"
_ERRORS = f"SELECT service, ts_s, sum(step)::DOUBLE AS bad FROM {_steps_sql(where="category = 'error'")} GROUP BY 1, 2"
_FETCH_SHARE = f"""SELECT service, ts_s, sum(bad) {_frame(300)} / nullif(sum(total) {_frame(300)}, 0) AS value FROM
 (SELECT service, ts_s, coalesce(bad, 0) AS bad, coalesce(total, 0) AS total FROM ({_FETCHES}) FULL JOIN ({_ERRORS}) USING (service, ts_s))"""
_FETCH_RATE = f"SELECT service, ts_s, sum(total) {_frame(300)} / 300.0::DOUBLE AS guard FROM ({_FETCHES})"
_MATCHED = f"SELECT service, ts_s, max(amount) * 4 AS guard FROM {_T} WHERE category <> 'view' GROUP BY 1, 2"
_SCORED_RATE = f"SELECT service, ts_s, sum(step) {_frame(300)} / 300.0::DOUBLE AS guard FROM (SELECT service, ts_s, sum(step) AS step FROM {_steps_sql(where="category = 'purchase'")} GROUP BY 1, 2)"

# Written out by hand, apart from the table of rules: value, when it is true, and for how many seconds it must be.
_RULES_SQL = {
    "fast_budget_burn": (_shares_sql((3600, 300)), "value > 0.0144::DOUBLE", 120),
    "slow_budget_burn": (_shares_sql((21600, 1800)), "value > 0.006::DOUBLE", 900),
    "latency_slo": (_quantile_sql(300, 0.05), "value > 0.05::DOUBLE", 300),
    "auth_rejections": (_shares_sql((300,)), "value > 0.05::DOUBLE", 300),
    "load_shedding": (_shares_sql((300,)), "value > 0.01::DOUBLE", 600),
    "feature_fetch_slow": (_quantile_sql(300, 0.025), "value > 0.025::DOUBLE", 300),
    "feature_fetch_errors": (_with_guard(_FETCH_SHARE, _FETCH_RATE), "value > 0.01::DOUBLE AND guard > 0.1::DOUBLE", 300),
    "feature_drift": (_gauge_sql(0.2, "max"), "value > 0.2::DOUBLE", 60),
    "performance_decay": (_with_guard(_gauge_sql(0.30, "min"), _MATCHED), "value < 0.30::DOUBLE AND guard > 200", 300),
    "reload_rejected": (_increase_sql(900, 1), "value > 0", 60),
    "reload_stalled": (_increase_sql(3600, 1), "value > 5", 600),
    "retries_exhausted": (_increase_sql(600, 1), "value > 0", 300),
    "circuit_open": (_increase_sql(600, 1), "value > 0", 60),
    "publish_failures": (_increase_sql(600, 1), "value > 0", 300),
    "dead_lettering": (_increase_sql(900, 3), "value > 10", 300),
    "inference_log_dropping": (_increase_sql(900, 1), "value > 0", 300),
    "exporter_down": (_gauge_sql(1.0, "min"), "value < 1", 300),
    "join_clock_stalled": (_with_guard(_gauge_sql(600.0, "max"), _SCORED_RATE), "value > 600 AND guard > 0", 300),
    "recompute_stalled": (_gauge_sql(60.0, "max"), "value > 60", 120),
    "drift_compute_errors": (_increase_sql(900, 1), "value > 0", 60),
    "poison_messages": (_increase_sql(900, 1), "value > 0", 60),
    "consume_errors": (_increase_sql(900, 1), "value > 0", 300),
    "alert_delivery_failing": (_increase_sql(900, 1), "value > 0", 60),
    "future_timestamps": (_increase_sql(900, 1), "value > 0", 300),
    "retrain_dispatch_failing": (_increase_sql(900, 1), "value > 0", 60),
}


def _rule_sql(name: str) -> str:
    value, true, for_s = _RULES_SQL[name]
    active = f"SELECT service, ts_s, coalesce({true}, false) AS active FROM ({value})"
    runs = f"SELECT *, sum((NOT active)::INT) OVER (PARTITION BY service ORDER BY ts_s) AS run FROM ({active})"
    firing = f"SELECT *, active AND ts_s - min(CASE WHEN active THEN ts_s END) OVER (PARTITION BY service, run) >= {for_s} AS firing FROM ({runs})"
    return f"SELECT '{name}' AS rule, service, count(*) FILTER (active) AS active, count(*) FILTER (firing) AS firing FROM ({firing}) GROUP BY service"


def _by_service(per):
    """Laid out by service once, in tasks of some ``_ROWS`` rows: no rule shuffles its rows again, and none's sorts outgrow a task."""
    return per.repartition(max(per.sparkSession.sparkContext.defaultParallelism, per.count() // _ROWS), "service")


@query(" UNION ALL ".join(map(_rule_sql, _RULES_SQL)))
def alert_rules(spark, d):
    """How often each of the 25 rules is active and firing, by service."""
    t = transactions(spark, d).select(F.col("card").cast("string").alias("service"), (F.col("id") % 2).cast("string").alias("endpoint"), F.expr("us div 200000000").alias("ts_s"), "amount", "category")
    per, out = _by_service(written(_per_second(t), "rule-seconds")), None
    for rule in rules.ALERT_RULES:
        found = rules.evaluate(rule, _series(rule, per))
        one = found.groupBy("service").agg(F.count_if(F.col("active")).alias("active"), F.count_if(F.col("firing")).alias("firing")).select(F.lit(rule.name).alias("rule"), "service", "active", "firing")
        out = one if out is None else out.union(one)
    return out
