"""Scores joined to late labels on a stream, with a bound on what waits: ids in shards, oldest first out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.contract import MonitorParams

SHARDS = 64
#: Closed ids are kept this much longer than waiting ones, as they guard against counting a match twice.
CLOSED_PER_WAITING = 5
_SIDES = ("score", "label", "closed")
#: Parts of a shard's entries, and places of a queue, that are stored as one value each.
BUCKETS, BLOCK = 64, 1024
_OUT = "kind string, seq bigint, id string, score double, decision boolean, label int, payload string"


class ShardMatcher(StatefulProcessor):
    """The join of one shard: an entry for each id and, for each side, the order in which ids came to wait or were closed.

    An id waits with a score, with a label, or is closed after a match. ``order`` maps places of a side's queue to ids; an id that comes again takes a
    new place and leaves the old one stale. Of each side at most ``limits`` entries stay; then the one that came first goes. An event
    touches its own entry and the heads of queues, so its work doesn't grow with what waits. Entries older than the clock
    less the retention are as good as gone wherever they stand, and are dropped once at the head.

    Entries are stored by buckets of ids, queues by blocks of places: a batch reads and writes each that it touches once, however many events touch it.
    """

    def __init__(self, retention_s: float, limits: dict[str, int]):
        self.retention_ms, self.limits = int(retention_s * 1000), limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "bucket int", "id array<string>, side array<string>, score array<double>, decision array<boolean>, label array<int>, at array<bigint>, place array<bigint>")
        self.order = handle.getMapState("order", "side string, block bigint", "id array<string>")
        self.ends = handle.getValueState("ends", ", ".join(f"head_{s} bigint, tail_{s} bigint, size_{s} bigint" for s in _SIDES) + ", newest bigint")

    # What a batch touches is read once and written once.

    def _open(self) -> None:
        values = self.ends.get() if self.ends.exists() else (0,) * 10
        self.head, self.tail, self.size = ({s: values[3 * k + i] for k, s in enumerate(_SIDES)} for i in range(3))
        self.newest, self.buckets, self.changed, self.blocks, self.appended, self.stored, self.ended = values[9], {}, set(), {}, set(), set(), set()

    def _bucket(self, id_: str) -> dict[str, tuple]:
        b = zlib.crc32((id_ or "").encode()) % BUCKETS
        if b not in self.buckets:
            there = self.entries.containsKey((b,))
            self.buckets[b] = {i: tuple(entry) for i, *entry in zip(*self.entries.getValue((b,)), strict=True)} if there else {}
            if there:
                self.stored.add(b)
        return self.buckets[b]

    def _get(self, id_: str) -> tuple | None:
        return self._bucket(id_).get(id_)

    def _set(self, id_: str, entry: tuple | None) -> None:
        held = self._bucket(id_)
        if entry is None:
            held.pop(id_, None)
        else:
            held[id_] = entry
        self.changed.add(zlib.crc32((id_ or "").encode()) % BUCKETS)

    def _places(self, side: str, place: int) -> list[str]:
        """The ids of the block that a place is in, in order."""
        at = (side, place // BLOCK)
        if at not in self.blocks:
            there = self.order.containsKey(at)
            self.blocks[at] = list(self.order.getValue(at)[0]) if there else []
            if there:
                self.stored.add(at)
        return self.blocks[at]

    def _remove(self, id_: str) -> None:
        entry = self._get(id_)
        if entry is not None:
            self.size[entry[0]] -= 1
            self._set(id_, None)

    def _put(self, id_: str, side: str, score: float | None, decision: bool | None, label: int | None, at: int) -> None:
        self._remove(id_)
        place = self.tail[side]
        self._places(side, place).append(id_)
        self.appended.add((side, place // BLOCK))
        self.tail[side] += 1
        self.size[side] += 1
        self._set(id_, (side, score, decision, label, at, place))
        while self.size[side] > self.limits[side]:
            self._pop(side)

    def _first(self, side: str) -> tuple | None:
        """The entry at the head of a side's queue, None if its place is stale."""
        id_ = self._places(side, self.head[side])[self.head[side] % BLOCK]
        entry = self._get(id_)
        return (id_, entry) if entry is not None and entry[0] == side and entry[5] == self.head[side] else None

    def _pop(self, side: str) -> None:
        first = self._first(side)
        if first:
            self._remove(first[0])
        self.head[side] += 1
        if self.head[side] % BLOCK == 0:
            self.ended.add((side, self.head[side] // BLOCK - 1))

    def _close(self, oldest: int) -> None:
        for side in _SIDES:
            while self.head[side] < self.tail[side] and ((first := self._first(side)) is None or first[1][4] < oldest):
                self._pop(side)
        for b in self.changed:
            if held := self.buckets[b]:
                self.entries.updateValue((b,), (list(held), *(list(x) for x in zip(*held.values(), strict=True))))
            elif b in self.stored:
                self.entries.removeKey((b,))
        for at in self.appended - self.ended:
            self.order.updateValue(at, (self.blocks[at],))
        for at in self.ended & self.stored:
            self.order.removeKey(at)
        self.ends.update((*(x[s] for s in _SIDES for x in (self.head, self.tail, self.size)), self.newest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        clock, out = timerValues.getCurrentWatermarkInMs(), []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.kind not in ("score", "label"):
                out.append((row.kind, row.seq, None, None, None, None, None))
                continue
            t = int(row.t.timestamp() * 1000)
            if row.kind == "score" and pd.notna(row.payload):
                out.append(("scored", row.seq, row.id, row.score, None, None, row.payload))
            clock = max(clock, t)
            oldest = clock - self.retention_ms
            entry = self._get(row.id)
            if entry is not None and entry[4] < oldest:
                self._remove(row.id)
                entry = None
            if t < oldest or (entry is not None and entry[0] == "closed"):
                continue
            self.newest = max(self.newest, t)
            decision = None if row.kind == "label" or pd.isna(row.decision) else bool(row.decision)
            score, label = (float(row.score), None) if row.kind == "score" else (None, int(row.label))
            if entry is None or entry[0] == row.kind:
                self._put(row.id, row.kind, score, decision, label, t)
                continue
            if row.kind == "label":
                score, decision = entry[1:3]
            else:
                label = entry[3]
            out.append(("match", row.seq, row.id, score, decision, label, None))
            self._put(row.id, "closed", None, None, None, t)
        self._close(clock - self.retention_ms)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(self.newest, clock) + self.retention_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["kind", "seq", "id", "score", "decision", "label", "payload"]).astype({"score": "Float64", "label": "Int32", "decision": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.entries, self.order, self.ends):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def match_events(events: DataFrame, retention_s: float, max_ids: int = MonitorParams().max_ids, shards: int = SHARDS) -> DataFrame:
    """``kind, seq, id, score, decision, label, payload`` of a stream ``events (kind, seq, id, t timestamp, score, decision, label, payload)``.

    Events of kind ``score`` and ``label`` are matched by id and give rows of kind ``match``, with the place of the event that completed them; a score with a
    payload also gives a row of kind ``scored``. Events of other kinds pass as they are, without an id. At most ``max_ids`` scores wait, and as many labels, and five times as many closed ids are
    remembered: a shard has its even part of these bounds and drops what came first.
    """
    per = -(-max_ids // shards)
    limits = {"score": per, "label": per, "closed": CLOSED_PER_WAITING * per}
    marked = events.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("id", F.col("seq").cast("string"))), F.lit(shards))).withWatermark("t", f"{int(retention_s * 1000)} milliseconds")
    return marked.groupBy("shard").transformWithStateInPandas(statefulProcessor=ShardMatcher(retention_s, limits), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
