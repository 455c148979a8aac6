"""Replay of past events at a warped pace, and the schedule of their late labels."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.contract import ReplayParams
from riskloom.functions.ordering import running
from riskloom.functions.scalars import hash_u32
from riskloom.operators.velocity import seconds_since_previous
from riskloom.sources.tables import delete_path, new_path


def replay_delays(df: DataFrame, *, us: str = "us", tie: str = "id", warp: float = 2000.0, max_wait_s: float | None = 2.0) -> DataFrame:
    """Adds ``delay_s``: the wait before each event, its gap over ``warp`` clipped to [0, max]; 0 for the first."""
    if warp <= 0:
        raise ValueError("warp must be positive")
    gaps = seconds_since_previous(df.withColumn("__all", F.lit(0)), card="__all", us=us, tie=tie, width_us=3600 * 1_000_000)
    wait = F.greatest(F.col("gap_s") / F.lit(float(warp)), F.lit(0.0))
    if max_wait_s is not None:
        wait = F.least(wait, F.lit(float(max_wait_s)))
    return gaps.withColumn("delay_s", wait).drop("gap_s", "__all")


def emission_offsets(df: DataFrame, *, us: str = "us", tie: str = "id", warp: float = 2000.0, max_wait_s: float | None = 2.0) -> DataFrame:
    """Adds ``offset_s``: seconds from the start of the replay, the running sum of the delays."""
    return running(replay_delays(df, us=us, tie=tie, warp=warp, max_wait_s=max_wait_s), us, [tie], {"offset_s": F.col("delay_s")})


def label_schedule(df: DataFrame, params: ReplayParams = ReplayParams(), seed: int = 42, *, us: str = "us", id: str = "id") -> DataFrame:
    """Adds ``label_offset_s``: emission plus the warped lag, spread by a uniform factor in [1 - jitter, 1 + jitter]."""
    u = hash_u32(seed, F.col(id)) / F.lit(2.0**32)
    lag = params.label_lag_days * 86_400 / params.warp
    out = emission_offsets(df, us=us, tie=id, warp=params.warp, max_wait_s=params.max_wait_s)
    return out.withColumn("label_offset_s", F.col("offset_s") + F.lit(lag) * (F.lit(1 - params.jitter) + F.lit(2 * params.jitter) * u))


def publish(df: DataFrame, path: str, *, card: str = "card", us: str = "us", partitions: int | None = None, mode: str = "append") -> None:
    """Write events keyed by card, in time order per card, as files that a file stream reads."""
    dealt = df.repartition(partitions, card) if partitions else df.repartition(card)
    dealt.sortWithinPartitions(us).write.mode(mode).parquet(path)


def wall_clock(spark: SparkSession) -> DataFrame:
    """A stream of ``timestamp``: ten rows a second of the machine's time."""
    return spark.readStream.format("rate").option("rowsPerSecond", 10).load().select("timestamp")


def step_clock(spark: SparkSession, tick_s: float) -> DataFrame:
    """A stream of ``timestamp`` whose every batch is one tick later, however long it takes: a replay as fast as it goes, in the same batches each time."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).option("startTimestamp", 0)
    return source.option("advanceMillisPerBatch", round(tick_s * 1000)).load().select("timestamp")


def by_offset(df: DataFrame, offset: str = "offset_s") -> DataFrame:
    """The schedule as a table in order of its offsets, so that a tick reads the row groups of its own stretch only."""
    path = new_path(df.sparkSession, "schedule")
    df.repartitionByRange(offset).sortWithinPartitions(offset).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PROGRESS = "start_us bigint, upto_s double, delivered bigint, batch bigint"


class Replay:
    """Publishes each event of a schedule below ``path/events`` once a clock is as far from its first tick as the event's offset.

    A tick writes the events that fell due since the tick before, keyed by card and in time order per card, then how far it is and how many
    events are out; only the last two such notes are kept. A tick that is run again after a failure overwrites its own folders, and a replay that
    is started again with its checkpoint goes on where it stopped; what fell due meanwhile comes with its first tick. Events without an
    offset are never due.
    """

    def __init__(self, schedule: DataFrame, path: str, *, offset: str = "offset_s", card: str = "card", us: str = "us"):
        self.schedule, self.path, self.offset, self.card, self.us = schedule, path, offset, card, us
        self.spark, self.tick, self.ended = schedule.sparkSession, threading.Lock(), False

    def _notes(self) -> list[Row]:
        try:
            return self.spark.read.schema(_PROGRESS).parquet(f"{self.path}/progress").orderBy("batch").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # no tick yet
                raise
            return []

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        with self.tick:
            if self.ended:
                return
            notes = [n for n in self._notes() if n["batch"] < batch_id]
            now, before = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0], notes[-1] if notes else None
            if now is None:
                return
            start = before["start_us"] if before else now
            upto = max((now - start) / 1e6, before["upto_s"] if before else 0.0)
            due = self.schedule.where(F.col(self.offset) <= upto)
            if before:
                due = due.where(F.col(self.offset) > before["upto_s"])
            out = f"{self.path}/events/batch={batch_id}"
            publish(due, out, card=self.card, us=self.us, mode="overwrite")
            n = self.spark.read.schema(self.schedule.schema).parquet(out).count() + (before["delivered"] if before else 0)
            self.spark.createDataFrame([(start, upto, n)], "start_us bigint, upto_s double, delivered bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}")
            for old in notes[:-1]:
                delete_path(self.spark, f"{self.path}/progress/batch={old['batch']}")

    def start(self, clock: DataFrame, checkpoint: str, *, tick_s: float | None = None) -> StreamingQuery:
        """``tick_s`` is the least time between ticks, None for none."""
        writer = clock.writeStream.foreachBatch(self._run).option("checkpointLocation", checkpoint)
        self.ended = False
        return (writer.trigger(processingTime=f"{tick_s:g} seconds") if tick_s else writer).start()

    def delivered(self) -> tuple[int, float]:
        """Events that are out, and the offset up to which they are, between two ticks; ``(0, -inf)`` before the first."""
        with self.tick:
            notes = self._notes()
        return (notes[-1]["delivered"], notes[-1]["upto_s"]) if notes else (0, float("-inf"))

    def finish(self, query: StreamingQuery, *, stop: Callable[[], bool] = lambda: False, poll_s: float = 0.2) -> int:
        """Wait until the last event is out or ``stop`` says so, let the tick under way end, then end the stream; how many events are out. A failed stream raises."""
        last = self.schedule.agg(F.max(self.offset)).first()[0]
        while last is not None and query.isActive and not stop() and self.delivered()[1] < last:
            time.sleep(poll_s)
        with self.tick:
            self.ended = True
        query.stop()
        if query.exception():
            raise query.exception()
        return self.delivered()[0]
