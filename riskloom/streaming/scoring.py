"""Scoring streams: decode, score, route bad events to the dead letters; alerts and retraining."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.contract import TRANSACTION_EVENT, MonitorParams
from riskloom.operators.drift import breach_latch, cooldown
from riskloom.operators.prepare import event_reason


def decode(events: DataFrame, payload: str = "value", schema: T.StructType = TRANSACTION_EVENT) -> DataFrame:
    """Adds ``event`` (struct) and ``reason`` (null for good ones) to rows with a JSON text."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    e = events.withColumn("event", F.from_json(payload, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    x = lambda c: F.col(f"event.{c}")
    raw = any(f.name == "raw" for f in schema.fields)
    reason = event_reason(x("amount"), x("transaction_id"), x("card_id"), x("_corrupt").isNotNull(), F.col(payload), x("raw.v") if raw else None, x("raw.categorical") if raw else None)
    return e.withColumn("reason", reason)


def score_and_route(good_path: str, dead_path: str, score: Callable[[DataFrame], DataFrame], payload: str = "value", schema: T.StructType = TRANSACTION_EVENT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: predictions to one table, dead letters (original columns and reason) to another.

    Each batch overwrites its own folder, so a batch that is replayed after a failure leaves the same rows once; the
    checkpoint moves on only when both writes are done.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch, payload, schema).persist()
        dead = decoded.where("reason is not null").drop("event")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        score(decoded.where("reason is null")).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        decoded.unpersist()

    return run


def start_scoring(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], *, once: bool = True, every_s: float = MonitorParams().recompute_s) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_s:g} seconds")).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_options(servers: str, topic: str, *, start: str = "earliest", since_ms: int | None = None) -> dict[str, str]:
    """Source options: from the earliest or latest offset, or per partition from a publish time on (its end where nothing is that recent).

    Offsets are committed by the stream's checkpoint alone, after the batch's writes; a rewound or latest start applies to a new checkpoint only.
    """
    if start not in ("earliest", "latest"):
        raise ValueError(f"unknown start {start!r}")
    where = {"startingOffsets": start} if since_ms is None else {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", "failOnDataLoss": "true"} | where


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str | int | None) -> DataFrame:
    """A Kafka source (see ``kafka_options``). Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()


def keyed(rows: DataFrame, key: str, value: Column | None = None, headers: dict[str, Column] | None = None) -> DataFrame:
    """``key, value, headers`` as a log sink takes them: the value is the row as JSON unless given; rows without a key get none."""
    body = F.to_json(F.struct("*")) if value is None else value
    head = F.array(*[F.struct(F.lit(n).alias("key"), v.cast("binary").alias("value")) for n, v in headers.items()]) if headers else F.lit(None).cast("array<struct<key: string, value: binary>>")
    return rows.select(F.col(key).cast("string").alias("key"), body.cast("string").alias("value"), head.alias("headers"))


def dead_letters(decoded: DataFrame, key: str = "key", payload: str = "value") -> DataFrame:
    """Rejected events as they came, with the reason as a header."""
    return keyed(decoded.where("reason is not null"), key, F.col(payload), {"reason": F.col("reason")})


#: Producer settings: a record is written once and confirmed by all replicas before the batch counts as done.
CONFIRMED = {"kafka.enable.idempotence": "true", "kafka.acks": "all", "includeHeaders": "true"}


def write_log(rows: DataFrame, servers: str, topic: str) -> None:
    """Send a micro-batch of ``keyed`` rows to a log and wait until it is confirmed: an error fails the batch, which is then replayed."""
    rows.write.format("kafka").options(**CONFIRMED).option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def score_to_log(servers: str, good_topic: str, dead_topic: str, score: Callable[[DataFrame], DataFrame], key: str = "card_id", send: Callable[[DataFrame, str, str], None] = write_log) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function like ``score_and_route`` that writes to a log: predictions under ``key``, dead letters under their own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch).persist()
        try:
            send(dead_letters(decoded), servers, dead_topic)
            send(keyed(score(decoded.where("reason is null")), key), servers, good_topic)
        finally:
            decoded.unpersist()

    return run


def log_inference(batch: DataFrame, path: str, batch_id: int) -> bool:
    """Best effort: scored features with an id go to a table; False where the batch could not be written, which stops nothing."""
    try:
        batch.where("transaction_id is not null").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    except Exception as error:  # logging never stops scoring
        logging.getLogger(__name__).warning("batch %s is not logged: %s", batch_id, type(error).__name__)
        return False
    return True


def retry_after_s(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number of seconds or an HTTP date (UTC), not below 0; null if it is neither."""
    date = F.regexp_extract(header, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.try_to_timestamp(F.nullif(date, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(header.try_cast("double"), F.unix_micros(at) / 1e6 - F.unix_micros(now) / 1e6)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def shed_delay_s(header: Column, now: Column, base: float = 0.5, cap: float = 30.0) -> Column:
    """The wait after a throttled call: the header's within [base, cap], else the base."""
    return F.coalesce(F.least(F.greatest(retry_after_s(header, now), F.lit(base)), F.lit(cap)), F.lit(base))


def outcome(status: Column) -> Column:
    """What an HTTP status of a scoring service means; null stands for a failed call."""
    return (
        F.when(status.isNull() | (status >= 500), "unavailable").when(status == 429, "throttled").when(status.isin(401, 403), "unavailable")
        .when(status.between(200, 299), "ok").otherwise("rejected")
    )


def breaker_trips(outcomes: DataFrame, order: str, required: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``fires`` where ``required`` unavailable outcomes in a row are complete; throttling neither counts nor resets."""
    return breach_latch(outcomes, order=order, breached=F.when(F.col("outcome") == "throttled", None).otherwise(F.col("outcome") == "unavailable"), required=required, by=by)


class CircuitBreaker:
    """Opens after consecutive failures; then one probe per cooldown; a success closes it."""

    def __init__(self, required: int = 3, cooldown_s: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.required, self.cooldown_s, self.clock, self.failures, self.probed = required, cooldown_s, clock, 0, None

    def allows(self) -> bool:
        if self.failures < self.required:
            return True
        now = self.clock()
        if self.probed is None or now - self.probed >= self.cooldown_s:
            self.probed = now
            return True
        return False

    def record(self, ok: bool) -> None:
        if ok:
            self.failures, self.probed = 0, None
        else:
            self.failures += 1
            if self.failures == self.required:
                self.probed = self.clock()


def alerts(cycles: DataFrame, params: MonitorParams = MonitorParams(), order: str = "cycle") -> DataFrame:
    """``cycle, kind, metric, value, threshold`` of monitor cycles ``(cycle, max_psi, auprc, matched)`` that fire after the debounce.

    A cycle without PSI (null) leaves the drift streak as it is.
    """
    drifted = breach_latch(cycles, order=order, breached=F.col("max_psi") > params.psi, required=params.debounce).where("fires")
    weak = F.coalesce((F.col("auprc") < params.auprc_floor) & (F.col("matched") >= params.min_matched), F.lit(False))
    decayed = breach_latch(cycles, order=order, breached=weak, required=params.debounce).where("fires")
    row = lambda df, kind, metric, value, limit: df.select(order, F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.col(value).alias("value"), F.lit(float(limit)).alias("threshold"))
    return row(drifted, "data_drift", "feature_drift_psi", "max_psi", params.psi).union(row(decayed, "concept_drift", "rolling_auprc", "auprc", params.auprc_floor))


def retrain_times(alert_rows: DataFrame, seconds: float, at_s: str = "at_s") -> DataFrame:
    """``at_s``: when retraining is dispatched: any kind of alert, at most once in ``seconds``."""
    return cooldown(alert_rows.withColumn("__all", F.lit("retrain")), by="__all", at_s=at_s, seconds=seconds).select(F.col(at_s).alias("at_s"))


class RetrainGate:
    """The same for a running service: a dispatch that fails doesn't start the cooldown."""

    def __init__(self, seconds: float, dispatch: Callable[[dict], None], clock: Callable[[], float] = time.time):
        self.seconds, self.dispatch, self.clock, self.last = seconds, dispatch, clock, None

    def handle(self, alert: dict) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            return False
        self.dispatch(alert)
        self.last = now
        return True
