"""Streams beside scoring: trailing velocity of each event, and the monitor whose cycles take up only what is new."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.contract import CostMatrix, MonitorParams
from riskloom.operators import drift
from riskloom.operators.velocity import DAY_US
from riskloom.sources.tables import delete_path, written
from riskloom.streaming import bounded, matching, monitor, scoring

#: Parts that a window is cut into on a stream, and groups of cards that share one state.
PARTS, BUCKETS = 16, 256
_FOLDS = {"n": "sum", "total": "sum", "most": "max", "last": "max"}


class TrailingVelocity(StatefulProcessor):
    """Per bucket of cards what the parts of a window add up to for each card, and their events in pieces; each new event is answered from those before it.

    An event needs the sums of the whole parts inside its window, those of its own part and, of the part in which the window starts, the events
    from there on, which are read once for a batch and summed up from the end once. A part's sums do for its own events as long as
    they are younger than what it holds. So the work of an event doesn't grow with the events in its window; a batch writes its own events and
    the sums of the parts that they fall in. All cards of a bucket are answered at once, in columns, and share the exchanges with the state store.
    """

    def __init__(self, window_us: int):
        self.window_us, self.step = window_us, -(-window_us // PARTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "part bigint", "card array<string>, n array<bigint>, total array<double>, most array<double>, last array<bigint>, pieces bigint")
        self.pieces = handle.getMapState("pieces", "part bigint, piece bigint", "card array<string>, us array<bigint>, amount array<double>")

    def _stored(self, watermark_ms: int) -> dict[int, tuple]:
        """Sums by part; parts that no event at or after the watermark can reach are deleted."""
        found = {key[0]: value for key, value in list(self.sums.iterator())}
        for p in [p for p in found if self._ends_ms(p) <= watermark_ms]:
            for k in range(found[p][5]):
                self.pieces.removeKey((p, k))
            self.sums.removeKey((p,))
            del found[p]
        return found

    def _ends_ms(self, part: int) -> int:
        return ((part + 1) * self.step + self.window_us) // 1000 + 1

    def _events(self, parts: list[int], stored: dict[int, tuple]) -> pd.DataFrame:
        pieces = {(p, k): self.pieces.getValue((p, k)) for p in parts for k in range(stored[p][5])}
        return _columns(["card", "us", "amount"], [(p, *value) for (p, _), value in pieces.items()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        stored = self._stored(timerValues.getCurrentWatermarkInMs())
        code, cards = pd.factorize(new["card"])
        us, amount = new["us"].to_numpy("int64"), new["amount"].to_numpy("float64")
        own, low = us // self.step, us - self.window_us
        first = low // self.step
        there = ~np.isnan(amount)
        fresh = pd.DataFrame({"card": code, "part": own, "us": us, "amount": amount})[there]
        added = fresh.groupby(["card", "part"], as_index=False).agg(n=("us", "size"), total=("amount", "sum"), most=("amount", "max"), last=("us", "max"))
        held = _columns(["card", *_FOLDS], [(p, *v[:5]) for p, v in stored.items()])
        held["card"] = cards.get_indexer(held["card"])
        held = held[held["card"] >= 0].astype(dict.fromkeys(("card", "part", "n", "last"), "int64") | dict.fromkeys(("total", "most"), "float64"))

        marks = np.unique(np.concatenate([held["part"].to_numpy("int64"), own]))
        place = lambda card, part: np.asarray(card) * (len(marks) + 1) + np.searchsorted(marks, part)
        n, total, most = np.zeros(len(us), "int64"), np.zeros(len(us)), np.full(len(us), -np.inf)

        def take(ok: np.ndarray, counts: np.ndarray, totals: np.ndarray, largest: np.ndarray, at: np.ndarray) -> None:
            n[ok] += counts[at[ok]]
            total[ok] += totals[at[ok]]
            most[ok] = np.maximum(most[ok], largest[at[ok]])

        every = pd.concat([held, added]).groupby(["card", "part"], as_index=False).agg(_FOLDS)  # in order of both
        places, sums = place(every["card"], every["part"]), [every[c].to_numpy() for c in ("n", "total", "most")]
        at, end = np.searchsorted(places, place(code, first + 1)), np.searchsorted(places, place(code, own))
        while (ok := at < end).any():
            take(ok, *sums, at)
            at = at + 1

        held = held.sort_values(["card", "part"])
        places, last = place(held["card"], held["part"]), held["last"].to_numpy()
        at_own, has_own = _find(places, place(code, own))
        has_first = _find(places, place(code, first))[1] & np.isin(first, marks)
        late = has_own & (last[at_own] >= us if len(last) else False)
        read = np.unique(np.concatenate([first[has_first], own[late]])).tolist()
        take(has_own & ~np.isin(own, read), *[held[c].to_numpy() for c in ("n", "total", "most")], at_own)

        before = self._events(read, stored)
        before["card"] = cards.get_indexer(before["card"])
        events = pd.concat([before[before["card"] >= 0], fresh]).astype({"card": "int64", "part": "int64", "us": "int64", "amount": "float64"})
        events = events.sort_values(["card", "us"], ignore_index=True)
        times = np.unique(events["us"].to_numpy())
        moment = lambda card, t: np.asarray(card) * (len(times) + 1) + np.searchsorted(times, t)
        moments, ecard, epart = moment(events["card"], events["us"]), events["card"].to_numpy(), events["part"].to_numpy()
        for at, part, by in ((np.searchsorted(moments, moment(code, us)) - 1, own, events), (np.searchsorted(moments, moment(code, low)), first, events[::-1])):
            groups = by.groupby(["card", "part"], sort=False)
            running = [(groups.cumcount() + 1), groups["amount"].cumsum(), groups["amount"].cummax()]  # from the part's start, or from its end
            ok = (at >= 0) & (at < len(events))
            ok[ok] = (ecard[at[ok]] == code[ok]) & (epart[at[ok]] == part[ok])
            take(ok, *[x.sort_index().to_numpy() for x in running], at)

        newest = np.full(len(cards), np.iinfo("int64").min)
        np.maximum.at(newest, code, us)
        np.maximum.at(newest, held["card"].to_numpy(), last)
        oldest = (newest - self.window_us) // self.step
        self._keep(stored, fresh[fresh["part"] >= oldest[fresh["card"]]], added[added["part"] >= oldest[added["card"]]], cards)
        self._wake(stored)
        some = n > 0
        yield pd.DataFrame({"id": new["id"], "v_count": n, "v_sum": total, "v_mean": np.divide(total, n, out=np.zeros(len(n)), where=some), "v_max": np.where(some, most, 0.0)})

    def _keep(self, stored: dict[int, tuple], fresh: pd.DataFrame, added: pd.DataFrame, cards: pd.Index) -> None:
        """Write what is new of the parts that a later window can reach."""
        sums = _by_part(added, cards, list(_FOLDS))
        for p, events in _by_part(fresh, cards, ["us", "amount"]).items():
            held = stored.get(p, ([], [], [], [], [], 0))
            self.pieces.updateValue((p, held[5]), tuple(events))
            known = dict(zip(held[0], zip(*held[1:5], strict=True), strict=True))
            for card, n, total, most, last in zip(*sums[p], strict=True):
                n0, total0, most0, last0 = known.get(card, (0, 0.0, most, last))
                known[card] = n0 + n, total0 + total, max(most0, most), max(last0, last)
            stored[p] = (list(known), *map(list, zip(*known.values(), strict=True)), held[5] + 1)
            self.sums.updateValue((p,), stored[p])

    def _wake(self, stored: dict[int, tuple]) -> None:
        """One timer, for the part that ends first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stored:
            self.handle.registerTimer(min(map(self._ends_ms, stored)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if left := self._stored(timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(min(map(self._ends_ms, left)))
        return iter(())

    def close(self) -> None:
        pass


def _columns(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    """Stored lists of several parts (the part, then a list for each name) as columns, with the part of each entry."""
    out = {c: [x for row in rows for x in row[i]] for i, c in enumerate(names, 1)}
    return pd.DataFrame(out | {"part": np.repeat([row[0] for row in rows], [len(row[1]) for row in rows]) if rows else []})


def _by_part(rows: pd.DataFrame, cards: pd.Index, names: list[str]) -> dict[int, list[list]]:
    """Lists of the cards and the named columns, for each part."""
    rows = rows.sort_values("part", kind="stable")
    parts, starts = np.unique(rows["part"].to_numpy(), return_index=True)
    lists = [cards[rows["card"]].tolist(), *(rows[c].tolist() for c in names)]
    return {int(p): [x[a:b] for x in lists] for p, a, b in zip(parts, starts, [*starts[1:], len(rows)], strict=True)}


def _find(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in sorted ``places``, and whether it does."""
    at = np.minimum(np.searchsorted(places, wanted), max(len(places) - 1, 0))
    return at, (places[at] == wanted) if len(places) else np.zeros(len(wanted), bool)


def velocity_stream(events: DataFrame, window_us: int = DAY_US, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``id, v_count, v_sum, v_mean, v_max`` of a stream ``events (id, card, us, amount)``: the batch operator's look-back [t - window, t) for each event.

    Exact where no event of a card comes in a later batch than a younger one of it; a late one is answered from what is kept.
    The events of one window are the state, which expires by event time. Cards are spread over ``buckets``, fixed for a checkpoint.
    """
    card = F.coalesce(F.concat(F.lit("="), F.col("card").cast("string")), F.lit(""))  # a missing card is one, too
    marked = events.select("id", card.alias("card"), "us", "amount", F.pmod(F.xxhash64("card"), F.lit(buckets)).alias("bucket"), F.timestamp_micros("us").alias("at")).withWatermark("at", delay)
    schema = "id bigint, v_count bigint, v_sum double, v_mean double, v_max double"
    return marked.groupBy("bucket").transformWithStateInPandas(statefulProcessor=TrailingVelocity(window_us), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def monitor_events(messages: DataFrame, features: Sequence[str]) -> DataFrame:
    """``kind, seq, id, t, score, decision, label, payload`` of messages ``(topic, value, published_s, seq)``: scores with their features as JSON, labels and poison."""
    routed = monitor.route(messages, ["seq", "published_s"]).where("status <> 'ignored'")
    good = F.col("status") == "ok"
    kind = F.when(good & F.col("score").isNotNull(), "score").when(good, "label").otherwise(F.col("status"))
    payload = F.when(kind == "score", F.to_json(F.struct(*[F.try_element_at("features", F.lit(c)).alias(c) for c in features])))
    return routed.select(kind.alias("kind"), "seq", F.when(good, F.col("id")).alias("id"), F.timestamp_micros((F.col("published_s") * 1_000_000).cast("bigint")).alias("t"), "score", "decision", F.col("label").cast("int").alias("label"), payload.alias("payload"))


def monitor_batches(folder: str, baseline: DataFrame | None, features: Sequence[str], params: MonitorParams = MonitorParams(), costs: CostMatrix = CostMatrix()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for the rows of ``match_events``: a cycle of the monitor over what is new and what the last cycle kept.

    Below ``folder`` each cycle writes the last ``window`` matches and the last ``window`` scored features, the streaks of both latches, one row ``cycle, max_psi, auprc, matched,
    cost, flagged_rate, poison`` and its alerts. It reads the windows and streaks of the cycle before and nothing older, and deletes those of the cycle
    before that, so its work is that of the batch and two windows, however long the stream runs. A cycle that is replayed reads the
    same and overwrites its own rows. The baseline is cut into bins once, when the monitor starts.
    """
    known = drift.baseline_bins(baseline, features) if baseline is not None else None
    shape = ", ".join(f"`{c}` double" for c in features)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def carried(name: str, rows: DataFrame, schema: str, order: str | None = None) -> DataFrame:
            """The cycle's table ``name``: its rows, in a window also those of the cycle before, the last ones of both."""
            if order:
                before = spark.read.schema(schema).parquet(f"{folder}/{name}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
                rows = rows.union(before).orderBy(F.desc(order)).limit(params.window)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            return spark.read.schema(schema).parquet(f"{folder}/{name}/batch={batch_id}")

        new = written(batch, "monitor-rows")
        matches = carried("matches", new.where("kind = 'match'").select(F.col("seq").alias("matched_seq"), "score", "decision", "label"), "matched_seq bigint, score double, decision boolean, label int", "matched_seq")
        scored = new.where("kind = 'scored'").select("seq", F.from_json("payload", shape).alias("f")).select("seq", *[F.col(f"f.`{c}`").alias(c) for c in features])
        window = carried("features", scored, f"seq bigint, {shape}", "seq")
        rolling = matching.metrics_of(matches, costs)
        psi = drift.psi_against(known, window, features) if known is not None and window.count() >= params.min_current else None
        cycle = monitor.cycle_row(rolling, psi, batch_id, params).join(rolling.select("cost", "flagged_rate")).join(new.agg(F.count_if(F.col("kind") == "poison").alias("poison")))
        cycle = carried("cycles", cycle, "cycle bigint, max_psi double, auprc double, matched bigint, weak boolean, cost double, flagged_rate double, poison bigint")
        streaks = spark.read.schema(_STREAKS).parquet(f"{folder}/latches/batch={batch_id - 1}") if batch_id else spark.createDataFrame([(0, 0)], _STREAKS)
        after = carried("latches", cycle.join(streaks).select(_streak(F.col("max_psi") > params.psi, "drifted"), _streak(F.col("weak"), "decayed")), _STREAKS)  # two rows of one
        carried("alerts", _alerts(cycle.join(after), params), "cycle bigint, kind string, metric string, value double, threshold double")
        for name in ("matches", "features", "latches"):
            delete_path(spark, f"{folder}/{name}/batch={batch_id - 2}")

    return run


_STREAKS = "drifted bigint, decayed bigint"


def _streak(breached, name: str):
    """Breaches in a row, up to now; a cycle without a value leaves them as they are."""
    return F.when(breached.isNull(), F.col(name)).when(breached, F.col(name) + 1).otherwise(F.lit(0).cast("bigint")).alias(name)


def _alerts(cycle: DataFrame, params: MonitorParams) -> DataFrame:
    """Alerts of the latches whose streak has just reached the debounce."""
    fires = lambda name, breached: (F.col(name) == params.debounce) & F.coalesce(breached, F.lit(False))
    row = lambda kind, metric, value, limit: F.struct("cycle", F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.col(value).alias("value"), F.lit(float(limit)).alias("threshold"))
    drifted = F.when(fires("drifted", F.col("max_psi") > params.psi), row("data_drift", "feature_drift_psi", "max_psi", params.psi))
    decayed = F.when(fires("decayed", F.col("weak")), row("concept_drift", "rolling_auprc", "auprc", params.auprc_floor))
    return cycle.select(F.explode(F.array_compact(F.array(drifted, decayed))).alias("a")).select("a.*")


def start_monitor(messages: DataFrame, folder: str, baseline: DataFrame | None, features: Sequence[str], params: MonitorParams = MonitorParams(), *, once: bool = False, shards: int = bounded.SHARDS):
    """The monitor as a running stream: a cycle every ``recompute_s`` seconds of processing time, or at once through all there is."""
    rows = bounded.match_events(monitor_events(messages, features), params.retention_s, params.max_ids, shards)
    return scoring.start_scoring(rows, f"{folder}/checkpoint", monitor_batches(folder, baseline, features, params), once=once, every_s=params.recompute_s)
