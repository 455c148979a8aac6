"""Metric rules over counters and gauges ``(ts_s, metric, labels, value)``, and canary decisions.

``rate`` and ``increase`` are sums of non-negative steps over (t - window, t]: a counter that falls was reset and
counts from 0. Nothing is extrapolated at the ends of a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.contract import CanaryParams
from riskloom.functions.ordering import ordered_fold, previous, quantiles, trailing
from riskloom.functions.scalars import safe_ratio
from riskloom.operators.velocity import asof_join


def steps(series: DataFrame, by: Sequence[str], ts: str = "ts_s", value: str = "value", stretch: int | None = 86_400) -> DataFrame:
    """Adds ``step``: growth since the previous sample of the series; after a reset the value itself, 0 for the first.

    A series is cut into stretches of ``stretch`` whole seconds (see ``previous``), so a long one is many tasks. None leaves it
    whole: no join, and no exchange where the rows are laid out by the first of ``by``.
    """
    if stretch is None:
        found = series.withColumn("__before", F.lag(value).over(Window.partitionBy(*by).orderBy(ts)))
    else:
        found = previous(series, by=by, order=[ts], value=value, name="__before", stretch=stretch)
    before = F.col("__before")
    return found.withColumn("step", F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))).drop("__before")


def increase(series: DataFrame, by: Sequence[str], window_s: int, ts: str = "ts_s", value: str = "value", name: str = "increase") -> DataFrame:
    """Adds the growth over the last ``window_s`` seconds at each sample (whole seconds)."""
    return trailing(steps(series, by, ts, value), by=by, at=ts, window=window_s, inclusive=True, total={name: "step"}).drop("step")


def rate(series: DataFrame, by: Sequence[str], window_s: int, **names: str) -> DataFrame:
    out = increase(series, by, window_s, name="__inc", **names)
    return out.withColumn("rate", F.col("__inc") / F.lit(float(window_s))).drop("__inc")


def sum_by(series: DataFrame, by: Sequence[str], ts: str = "ts_s", value: str = "value") -> DataFrame:
    return series.groupBy(*by, ts).agg(F.sum(value).alias(value))


def matching(series: DataFrame, metric: str, pattern: dict[str, str] | None = None) -> DataFrame:
    """The samples of a metric whose labels match the patterns whole."""
    found = series.where(F.col("metric") == metric)
    for k, v in (pattern or {}).items():
        found = found.where(F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).rlike(f"^(?:{v})$"))
    return found


def ratio_within(steps_: DataFrame, *, bad: str, total: str, order: str, by: Sequence[str], window_s: int, name: str) -> DataFrame:
    """Adds the share of ``bad`` in ``total`` over (t - window, t]; null where there is nothing."""
    sums = trailing(steps_, by=by, at=order, window=window_s, inclusive=True, total={"__bad": bad, "__total": total})
    return sums.withColumn(name, safe_ratio(F.col("__bad"), F.col("__total"))).drop("__bad", "__total")


def burn(steps_: DataFrame, *, bad: str, total: str, order: str, by: Sequence[str], limit: float, long_s: int, short_s: int) -> DataFrame:
    """Adds ``long_ratio``, ``short_ratio`` and ``burning``: both windows strictly above the limit."""
    out = steps_
    for n, w in (("long_ratio", long_s), ("short_ratio", short_s)):
        out = ratio_within(out, bad=bad, total=total, order=order, by=by, window_s=w, name=n)
    return out.withColumn("burning", F.coalesce((F.col("long_ratio") > limit) & (F.col("short_ratio") > limit), F.lit(False)))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float, le: str = "le", count: str = "count") -> DataFrame:
    """Quantile from cumulative buckets, linear within a bucket; the last finite bound if it lies in the open one.

    ``by`` rows have bounds ``le`` (infinity for the last) and cumulative counts. Null without observations.
    """
    w = Window.partitionBy(*by).orderBy(le)
    rows = buckets.withColumns({"lo": F.coalesce(F.lag(le).over(w), F.lit(0.0)), "below": F.coalesce(F.lag(count).over(w), F.lit(0)), "total": F.max(count).over(Window.partitionBy(*by))})
    hit = rows.where((F.col("total") > 0) & (F.col(count) >= F.col("total") * F.lit(q))).groupBy(*by).agg(F.min_by(F.struct(le, count, "lo", "below", "total"), le).alias("h"))
    inside = F.col("h.lo") + (F.col(f"h.{le}") - F.col("h.lo")) * safe_ratio(F.col("h.total") * F.lit(q) - F.col("h.below"), F.col(f"h.{count}") - F.col("h.below"))
    found = hit.select(*by, F.when(F.col(f"h.{le}") == float("inf"), F.col("h.lo")).otherwise(F.coalesce(inside, F.col("h.lo"))).alias("quantile"))
    return buckets.select(*by).distinct().join(found, list(by), "left")


def persists(samples: DataFrame, *, active: str, order: str, by: Sequence[str], for_s: int) -> DataFrame:
    """Adds ``firing``: the condition has held at every sample for at least ``for_s`` seconds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = samples.withColumn("__run", F.sum((~F.col(active)).cast("int")).over(w))
    since = F.min(F.when(F.col(active), F.col(order))).over(Window.partitionBy(*by, "__run"))
    return marked.withColumn("firing", F.col(active) & (F.col(order) - since >= for_s)).drop("__run")


def inhibit(alerts: DataFrame, source: str, target: str, equal: Sequence[str]) -> DataFrame:
    """Alerts without those named ``target`` for which one named ``source`` is there with equal labels."""
    sources = alerts.where(F.col("alertname") == source).select(*equal).distinct().withColumn("__s", F.lit(True))
    return alerts.join(sources, list(equal), "left").where(~((F.col("alertname") == target) & F.coalesce("__s", F.lit(False)))).drop("__s")


def grouped_alerts(alerts: DataFrame, by: Sequence[str] = ("service", "alertname")) -> DataFrame:
    return alerts.groupBy(*by).agg(F.count("*").alias("alerts"))


@dataclass(frozen=True)
class Guard:
    """A second condition: a metric's last value, or with a window its growth a second, must lie strictly above the limit."""

    metric: str
    limit: float
    window_s: int = 0


@dataclass(frozen=True)
class Rule:
    """A rule as data: how its value comes about, what makes it true and for how long it must be."""

    name: str
    kind: str  # increase | ratio | burn | quantile | gauge
    metric: str
    window_s: int
    limit: float
    for_s: int
    labels: tuple[tuple[str, str], ...] = ()
    short_s: int = 0
    op: str = ">"
    of: str = ""  # the metric that a ratio's total counts, where it is another
    guard: Guard | None = None


# Windows, limits and durations of the alert rules.
ALERT_RULES = (
    Rule("fast_budget_burn", "burn", "requests", 3600, 0.0144, 120, (("status", "5.."),), 300),
    Rule("slow_budget_burn", "burn", "requests", 21600, 0.006, 900, (("status", "5.."),), 1800),
    Rule("latency_slo", "quantile", "latency", 300, 0.05, 300),
    Rule("auth_rejections", "ratio", "requests", 300, 0.05, 300, (("status", "401|403"),)),
    Rule("load_shedding", "ratio", "requests", 300, 0.01, 600, (("status", "429"),)),
    Rule("feature_fetch_slow", "quantile", "feature_fetch", 300, 0.025, 300),
    Rule("feature_fetch_errors", "ratio", "feature_fetch_errors", 300, 0.01, 300, of="feature_fetch_count", guard=Guard("feature_fetch_count", 0.1, 300)),
    Rule("feature_drift", "gauge", "psi_max", 0, 0.2, 60),
    Rule("performance_decay", "gauge", "auprc", 0, 0.30, 300, op="<", guard=Guard("matched", 200)),
    Rule("reload_rejected", "increase", "reloads", 900, 0.0, 60, (("reason", "integrity|contract"),)),
    Rule("reload_stalled", "increase", "reloads", 3600, 5.0, 600, (("reason", "transient"),)),
    Rule("retries_exhausted", "increase", "retries_exhausted", 600, 0.0, 300),
    Rule("circuit_open", "increase", "circuit_open", 600, 0.0, 60),
    Rule("publish_failures", "increase", "publish_failures", 600, 0.0, 300),
    Rule("dead_lettering", "increase", "dead_letters", 900, 10.0, 300),
    Rule("inference_log_dropping", "increase", "inference_log_dropped", 900, 0.0, 300),
    Rule("exporter_down", "gauge", "up", 0, 1.0, 300, op="<"),
    Rule("join_clock_stalled", "gauge", "join_clock_lag", 0, 600.0, 300, guard=Guard("scored", 0.0, 300)),
    Rule("recompute_stalled", "gauge", "recompute_age", 0, 60.0, 120),
    Rule("drift_compute_errors", "increase", "drift_errors", 900, 0.0, 60),
    Rule("poison_messages", "increase", "poison", 900, 0.0, 60),
    Rule("consume_errors", "increase", "consume_errors", 900, 0.0, 300),
    Rule("alert_delivery_failing", "increase", "alert_failures", 900, 0.0, 60),
    Rule("future_timestamps", "increase", "future_timestamps", 900, 0.0, 300),
    Rule("retrain_dispatch_failing", "increase", "dispatch_failures", 900, 0.0, 60),
)
#: A guard's value counts for so many seconds after its sample.
STALE_S = 300


def _stepped(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """``step`` of each whole series (all its labels): only then may series be added."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return steps(series.withColumn("__series", key), [*by, "metric", "__series"], stretch=None)  # ``persists`` takes a service whole anyway


def _summed(stepped: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    return stepped.groupBy(*by, "ts_s").agg(*[F.sum(v).alias(n) for n, v in sums.items()])


def _guard_values(guard: Guard, series: DataFrame, service: str) -> DataFrame:
    """``service, ts_s, guard`` at each sample of the guard's metric."""
    found = matching(series, guard.metric)
    if not guard.window_s:
        return found.groupBy(service, "ts_s").agg(F.max("value").alias("guard"))
    per = _summed(_stepped(found, [service]), [service], {"step": F.col("step")})
    grown = trailing(per, by=[service], at="ts_s", window=guard.window_s, inclusive=True, total={"grown": "step"})
    return grown.select(service, "ts_s", (F.col("grown") / F.lit(float(guard.window_s))).alias("guard"))


def evaluate(rule: Rule, series: DataFrame, service: str = "service") -> DataFrame:
    """``service, ts_s, value, active, firing`` at each sample of the rule's metric (and of the total's).

    Series of a service are told apart by all their labels until their growth is known; then they are added. Every step keeps a
    service's rows together: of series laid out by service (``repartition``) only a guard's join shuffles any.
    """
    by = [service]
    bad = F.lit(True)
    for k, v in rule.labels:
        bad = bad & F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).rlike(f"^(?:{v})$")
    if rule.kind == "gauge":
        out = matching(series, rule.metric, dict(rule.labels)).groupBy(service, "ts_s").agg((F.max if rule.op == ">" else F.min)("value").alias("value"))
    elif rule.kind == "increase":
        per = _summed(_stepped(matching(series, rule.metric, dict(rule.labels)), by), by, {"step": F.col("step")})
        out = trailing(per, by=by, at="ts_s", window=rule.window_s, inclusive=True, total={"value": "step"}).select(service, "ts_s", "value")
    elif rule.kind in ("ratio", "burn"):
        both = series.where(F.col("metric").isin(rule.metric, rule.of or rule.metric))
        total = F.when(F.col("metric") == (rule.of or rule.metric), F.col("step")).otherwise(0.0)
        per = _summed(_stepped(both, by), by, {"total": total, "bad": F.when((F.col("metric") == rule.metric) & bad, F.col("step")).otherwise(0.0)})
        if rule.kind == "burn":
            b = burn(per, bad="bad", total="total", order="ts_s", by=by, limit=rule.limit, long_s=rule.window_s, short_s=rule.short_s)
            out = b.select(service, "ts_s", F.least("long_ratio", "short_ratio").alias("value"))
        else:
            out = ratio_within(per, bad="bad", total="total", order="ts_s", by=by, window_s=rule.window_s, name="value").select(service, "ts_s", "value")
    else:
        found = _stepped(matching(series, rule.metric), by).withColumn("le", F.col("labels")["le"].try_cast("double"))
        per = _summed(found, [service, "le"], {"step": F.col("step")})
        grown = trailing(per, by=[service, "le"], at="ts_s", window=rule.window_s, inclusive=True, total={"count": "step"})
        out = histogram_quantile(grown, [service, "ts_s"], 0.99).withColumnRenamed("quantile", "value")
    over = F.col("value") > rule.limit if rule.op == ">" else F.col("value") < rule.limit
    if rule.guard:
        guarded = asof_join(out, _guard_values(rule.guard, series, service), by=service, us="ts_s", right_tie="guard", values=["guard"], tolerance_us=STALE_S, width_us=86_400)
        out = guarded.drop("matched_us")
        over = over & (F.col("guard") > rule.guard.limit)
    return persists(out.withColumn("active", F.coalesce(over, F.lit(False))), active="active", order="ts_s", by=by, for_s=rule.for_s).select(service, "ts_s", "value", "active", "firing")


# -- Canary


def canary_decision(params: CanaryParams = CanaryParams(), final: str = "final") -> Column:
    """promote, hold or rollback from ``p99_s, error_rate, samples, agreement, auprc_ratio`` and the final-step flag."""
    slo = (F.col("p99_s") > params.max_p99_s) | (F.col("error_rate") > params.max_error_rate)
    quality = (F.col("agreement") < params.min_agreement) | F.coalesce(F.col("auprc_ratio") < params.min_auprc_ratio, F.lit(False))
    return (
        F.when(slo, "rollback").when(F.col("samples") < params.min_samples, "hold").when(quality, "rollback")
        .when(F.col(final) & F.col("auprc_ratio").isNull(), "hold").otherwise("promote")
    )


def run_canary(params: CanaryParams, observe: Callable[[float], str], apply_weight: Callable[[float], None]) -> str:
    """Walk the steps: a promote goes on, a hold repeats the step, a rollback or too many holds end at weight 0."""
    for weight in params.steps:
        apply_weight(weight)
        holds = 0
        while (decision := observe(weight)) == "hold":
            holds += 1
            if holds > params.max_holds:
                decision = "rollback"
                break
        if decision == "rollback":
            apply_weight(0.0)
            return "rollback"
    return "promoted"


def observation(stable: DataFrame, canary: DataFrame, id: str = "id") -> DataFrame:
    """``p99_s, error_rate, samples, agreement`` of canary rows ``(id, latency_s, failed, decision)`` against stable ones; the quantile is exact."""
    own = canary.agg(F.avg(F.col("failed").cast("double")).alias("error_rate"), F.count("*").alias("samples")).first()
    p99 = quantiles(canary.select(F.lit(0).alias("all"), "latency_s"), "all", "latency_s", [0.99]).first()
    both = canary.select(id, F.col("decision").alias("c")).join(stable.select(id, F.col("decision").alias("s")), id)
    agreement = both.agg(F.avg((F.col("c") == F.col("s")).cast("double")).alias("agreement"))
    return agreement.select(F.lit(p99["q"][0] if p99 else None).cast("double").alias("p99_s"), F.lit(own[0]).alias("error_rate"), F.lit(own[1]).alias("samples"), "agreement")


class _Bucket:
    """Tokens of one client: four numbers, whatever the number of its requests."""

    def __init__(self, capacity: float, refill: float):
        self.capacity, self.refill, self.tokens, self.last, self.allowed, self.denied = capacity, refill, capacity, None, 0, 0

    def take(self, times: Iterable[float]) -> None:
        tokens, last, allowed, n = self.tokens, self.last, 0, 0
        for t in times:
            if last is not None:
                tokens = min(self.capacity, tokens + (t - last) * self.refill)
            last = t
            n += 1
            if tokens >= 1:
                tokens -= 1
                allowed += 1
        self.tokens, self.last, self.allowed, self.denied = tokens, last, self.allowed + allowed, self.denied + n - allowed


def token_bucket(requests: DataFrame, *, client: str = "client", at_s: str = "at_s", id: str = "id", capacity: float = 120.0, refill: float = 20.0) -> DataFrame:
    """``client, allowed, denied``: a bucket of tokens per client, filled at ``refill`` a second; requests in order of time and ``id``.

    A client's requests are sorted and folded one after another, so one that is never idle takes no more memory than
    others. Requests without a time are left out.
    """
    rows = requests.select(client, F.col(at_s).cast("double").alias(at_s), id).where(F.col(at_s).isNotNull())
    kind = requests.schema[client].dataType.simpleString()
    return ordered_fold(
        rows, by=client, order=[at_s, id], start=lambda: _Bucket(float(capacity), float(refill)), step=lambda bucket, part: bucket.take(part[at_s].tolist()),
        end=lambda bucket: (bucket.allowed, bucket.denied), schema=f"`{client}` {kind}, allowed bigint, denied bigint",
    )
