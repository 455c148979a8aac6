"""Scores joined to late labels, in batch and as a stream, and rolling metrics of the matches.

The clock is the largest event time seen on either side. An arrival older than the clock less the retention is dropped
(one exactly that old is kept). Of an id one waiting side is kept, with its last arrival; the other side's arrival makes a
match, after which the id is closed until the clock has passed the match's event time by more than the retention. Then
it may match again. What waits longer than the retention is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.contract import CostMatrix, MonitorParams
from riskloom.functions.ordering import ordered_fold_rows, ranked, running
from riskloom.operators.metrics import auprc
from riskloom.sources.tables import written


class _Id:
    """What is known of one id: the side that waits, since when, and when it was last closed."""

    __slots__ = ("score", "decision", "label", "at", "seq", "closed")

    def __init__(self):
        self.score = self.decision = self.label = self.at = self.seq = self.closed = None


def _step(known: _Id, seq, t: float, clock: float, score: float | None, decision: bool | None, label: int | None, retention_s: float) -> tuple | None:
    """An id's next arrival; the match that it makes: ``kind, score, decision, label, seq, t``."""
    oldest = clock - retention_s
    if known.closed is not None and known.closed >= oldest:
        return None
    waits = known.at is not None and known.at >= oldest
    if waits and score is not None and known.label is not None:
        found = ("match", score, decision, known.label, seq, t)
    elif waits and label is not None and known.score is not None:
        found = ("match", known.score, known.decision, label, seq, t)
    else:
        known.score, known.label, known.decision, known.at, known.seq = score, label, decision, t, seq
        return None
    known.score = known.decision = known.label = known.at = known.seq = None
    known.closed = t
    return found


_ARRIVAL = ("seq", "t", "clock", "score", "decision", "label")


def _folded(arrivals: DataFrame, retention_s: float) -> DataFrame:
    """``id, kind, score, decision, label, seq, t`` of ``arrivals (seq, id, t, score, decision, label)``: each ``match``, and what is ``waiting`` at the end.

    Only the running clock needs the whole table in order. An id's arrivals are then folded in order with one small state, however many they are.
    """
    r = float(retention_s)
    if "decision" not in arrivals.columns:
        arrivals = arrivals.withColumn("decision", F.lit(None).cast("boolean"))
    live = running(arrivals.select("seq", "id", F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"), "decision", F.col("label").cast("int").alias("label")), "seq", [], {"clock": F.col("t")}, how="max").where(F.col("t") >= F.col("clock") - F.lit(r))
    kind = arrivals.schema["id"].dataType.simpleString()
    return ordered_fold_rows(
        live, by="id", order=["seq"], values=_ARRIVAL, start=_Id, step=lambda known, row: _step(known, *row, r), end=lambda k: None if k.at is None else ("waiting", k.score, k.decision, k.label, k.seq, k.at),
        schema=f"id {kind}, kind string, score double, decision boolean, label int, seq bigint, t double",
    )


def match_batch(arrivals: DataFrame, retention_s: float) -> DataFrame:
    """``id, score, decision, label, matched_seq`` of ``arrivals (seq, id, t, score, decision, label)``: one of score and label is null.

    ``seq`` is the order of arrival, without ties; ``decision`` comes with a score and may be missing.
    """
    return _folded(arrivals, retention_s).where("kind = 'match'").select("id", "score", "decision", "label", F.col("seq").alias("matched_seq"))


def _waiting(folded: DataFrame, arrivals: DataFrame, retention_s: float) -> DataFrame:
    clock = F.lit(float(arrivals.agg(F.max("t")).first()[0] or 0.0) - retention_s)
    side = F.when(F.col("score").isNotNull(), "pending").otherwise("early")
    return folded.where("kind = 'waiting'").where(F.col("t") >= clock).select(side.alias("side"), "id", "seq")


def _newest(found: DataFrame, max_ids: int) -> DataFrame:
    """Of each side the ``max_ids`` rows that came last."""
    return ranked(found, "seq", [], "nth", groups=["side"], descending=True).where(F.col("nth") <= max_ids).drop("nth")


def waiting(arrivals: DataFrame, retention_s: float, max_ids: int = MonitorParams().max_ids) -> DataFrame:
    """``side, id, seq`` of what waits after the last arrival; of each side the ``max_ids`` that came last, as the oldest go first."""
    found = written(_waiting(_folded(arrivals, retention_s), arrivals, retention_s), "waiting")  # read for the ranges of its order and for the ranks
    return _newest(found, max_ids)


def match_counts(arrivals: DataFrame, retention_s: float, max_ids: int | None = None) -> DataFrame:
    """``matched, pending``: pairs found, and all scores that still wait for a label; one fold gives both. Only where ``max_ids`` is given it bounds ``pending``."""
    arrivals = written(arrivals, "arrivals")  # read for the clock and for the matches
    folded = written(_folded(arrivals, retention_s).select("kind", "id", "score", "seq", "t"), "folded")
    pending = _waiting(folded, arrivals, retention_s).where("side = 'pending'").agg(F.count("*").alias("pending"))
    if max_ids is not None:
        pending = pending.select(F.least("pending", F.lit(max_ids).cast("bigint")).alias("pending"))  # as many as ``waiting`` leaves
    return folded.where("kind = 'match'").agg(F.count("*").alias("matched")).join(pending)  # two rows of one


#: Groups of ids that share one state on a stream; a batch reads and writes only the groups of its ids.
BUCKETS = 4096
_ENTRY = ("score", "decision", "label", "at", "closed")


class Matcher(StatefulProcessor):
    """The same join on a stream, for a bucket of ids; an id's clock is the watermark of both sides and its own times in the batch.

    A bucket's entries are one value: read once for a batch and written once, so the exchanges with the state store don't grow with ids.
    """

    def __init__(self, retention_s: float):
        self.retention_ms = int(retention_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entries", "id array<string>, score array<double>, decision array<boolean>, label array<int>, at array<bigint>, closed array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, out, clocks = timerValues.getCurrentWatermarkInMs(), [], {}
        known = {i: entry for i, *entry in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        part = pd.concat(list(rows)).sort_values("seq")
        times = part["t"].astype("datetime64[ms]").astype("int64").tolist()
        for id_, t, one, decided, y in zip(part["id"].tolist(), times, *(part[c].tolist() for c in ("score", "decision", "label")), strict=True):
            clock = clocks[id_] = max(clocks.get(id_, watermark), t)
            oldest = clock - self.retention_ms
            score, decision, label, at, closed = known.get(id_, (None,) * 5)
            if t < oldest or (closed is not None and closed >= oldest):
                continue
            if at is not None and at < oldest:
                score = decision = label = None
            scored = one is not None and one == one
            decided = bool(decided) if scored and decided is not None and decided == decided else None
            if scored and label is not None:
                out.append((id_, one, decided, label))
            elif not scored and score is not None:
                out.append((id_, score, decision, int(y)))
            else:
                known[id_] = (one, decided, None, t, closed) if scored else (None, None, int(y), t, closed)
                continue
            known[id_] = (None, None, None, None, t)
        self._keep(known, watermark - self.retention_ms)
        if out:
            yield pd.DataFrame(out, columns=["id", "score", "decision", "label"]).astype({"score": "float64", "label": "int32", "decision": "boolean"})

    def _keep(self, known: dict, oldest: int) -> None:
        """Write the entries that can still matter, and a timer for when the last of them is gone."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        newest = {i: max(x for x in entry[3:] if x is not None) for i, entry in known.items()}
        kept = [i for i, at in newest.items() if at >= oldest]
        if kept:
            self.state.update((kept, *([known[i][k] for i in kept] for k in range(len(_ENTRY)))))
            self.handle.registerTimer(max(newest[i] for i in kept) + self.retention_ms + 1)
        else:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def match_stream(arrivals: DataFrame, retention_s: float) -> DataFrame:
    """``id, score, decision, label`` of a stream ``arrivals (seq, id, t timestamp, score, decision, label)``. State expires by event time."""
    marked = arrivals.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).withWatermark("t", f"{int(retention_s)} seconds")
    return marked.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Matcher(retention_s), outputStructType="id string, score double, decision boolean, label int", outputMode="Append", timeMode="EventTime")


def last_matches(matches: DataFrame, window: int) -> DataFrame:
    return matches.orderBy(F.desc("matched_seq")).limit(window)


def rolling_metrics(matches: DataFrame, costs: CostMatrix = CostMatrix(), window: int = 5000) -> DataFrame:
    """``matched, auprc, cost, flagged_rate`` over the last ``window`` matches, by the decisions that were served; nulls if there are none."""
    last = written(last_matches(matches, window), "last-matches")  # at most ``window`` rows
    return metrics_of(last, costs)


def metrics_of(last: DataFrame, costs: CostMatrix = CostMatrix()) -> DataFrame:
    """The rolling metrics of a written table of matches."""
    hit, y = F.coalesce("decision", F.lit(False)), F.col("label") == 1
    cost = F.when(y & ~hit, F.lit(float(costs.false_negative))).when(~y & hit, F.lit(float(costs.false_positive))).otherwise(0.0)
    one = last.agg(F.count("*").alias("matched"), F.avg(cost).alias("cost"), F.avg(hit.cast("double")).alias("flagged_rate"))
    ap = auprc(last.select("score", "label")).agg(F.max("auprc").alias("auprc"))
    return one.join(ap).select("matched", "auprc", "cost", "flagged_rate")  # two rows of one


def below_floor(params: MonitorParams = MonitorParams()):
    """Strictly below the floor, with enough matches and a defined value."""
    return F.coalesce((F.col("auprc") < params.auprc_floor) & (F.col("matched") >= params.min_matched), F.lit(False))


def versions_seen(df: DataFrame, order: str, version: str = "model_version") -> DataFrame:
    """Adds ``version_max``: the largest model version up to each row."""
    return running(df, order, [], {"version_max": F.col(version)}, how="max")


def feature_window(scored: DataFrame, n: int, least: int, order: str = "seq") -> DataFrame | None:
    """The last ``n`` scored rows, repeats included; None while there are fewer than ``least``."""
    window = scored.orderBy(F.desc(order)).limit(n)
    return window if window.count() >= least else None


def ranked_matches(matches: DataFrame) -> DataFrame:
    return ranked(matches, "matched_seq", ["id"], "nth")
