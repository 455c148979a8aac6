"""Routing of monitored topics, and metric rows of a monitor cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.contract import LABEL_EVENT, SCORED_FEATURES_EVENT, MonitorParams
from riskloom.functions.scalars import event_time_seconds
from riskloom.operators import drift
from riskloom.streaming.matching import below_floor


def _ddl(schema) -> str:
    return f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in [*schema.fields])}, _corrupt: string>"


def route(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``topic, id, score, decision, label, features, status`` of messages ``(topic, value)``, and their columns to ``keep``.

    ``status`` is ``ok``, ``ignored`` (no payload, unknown topic) or ``poison`` (malformed, or outside its bounds).
    """
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    scored, label = F.col("topic") == "scored-features", F.col("topic") == "labels"
    m = messages.withColumns({"s": F.when(scored, F.from_json("value", _ddl(SCORED_FEATURES_EVENT), options)), "l": F.when(label, F.from_json("value", _ddl(LABEL_EVENT), options))})
    id_ = F.coalesce("s.transaction_id", "l.transaction_id")
    ok_score = F.col("s._corrupt").isNull() & F.col("s.fraud_score").between(0, 1) & (F.col("s.model_version") >= 1)
    ok_label = F.col("l._corrupt").isNull() & F.col("l.is_fraud").isin(0, 1)
    good = F.coalesce(F.length(id_).between(1, 128) & ((scored & ok_score) | (label & ok_label)), F.lit(False))
    status = F.when(F.col("value").isNull() | (F.col("value") == "") | ~(scored | label), "ignored").when(good, "ok").otherwise("poison")
    return m.select("topic", *keep, id_.alias("id"), F.col("s.fraud_score").alias("score"), F.col("s.decision").alias("decision"), F.col("l.is_fraud").alias("label"), F.col("s.features").alias("features"), status.alias("status"))


def event_clock(published_s: Column, now_s: Column, clock_s: Column, params: MonitorParams = MonitorParams()) -> Column:
    return event_time_seconds(published_s, now_s, clock_s, params.clock_skew_s)


def clock_lag(now_s: Column, clock_s: Column) -> Column:
    """Seconds the join clock is behind; null before the first event."""
    return F.when(clock_s.isNotNull(), F.greatest(F.lit(0.0), now_s - clock_s))


def metric_rows(cycle: DataFrame, at: str, names: Sequence[str]) -> DataFrame:
    """``ts_s, metric, labels, value``: one row for each named column of a cycle's row; null values give none."""
    parts = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return cycle.select(F.col(at).cast("bigint").alias("ts_s"), F.explode(F.array(*parts)).alias("m")).select("ts_s", "m.metric", F.create_map().cast("map<string,string>").alias("labels"), "m.value").where("value is not null")


def psi_rows(scores: DataFrame, ts_s: int, top: int = MonitorParams().top_n) -> DataFrame:
    """The largest PSI values as metric rows labelled by feature; a snapshot replaces the last one whole."""
    return drift.top_psi(scores, top).select(F.lit(ts_s).cast("bigint").alias("ts_s"), F.lit("psi").alias("metric"), F.create_map(F.lit("feature"), F.col("feature")).alias("labels"), F.col("psi").alias("value"))


def cycle_row(rolling: DataFrame, psi: DataFrame | None, cycle: int, params: MonitorParams = MonitorParams()) -> DataFrame:
    """``cycle, max_psi, auprc, matched, weak``: what the latches of a cycle see; max_psi is null when PSI was skipped."""
    worst = psi.agg(F.max("psi")).first()[0] if psi is not None else None
    return rolling.select(F.lit(cycle).cast("bigint").alias("cycle"), F.lit(worst).cast("double").alias("max_psi"), "auprc", "matched").withColumn("weak", below_floor(params))
