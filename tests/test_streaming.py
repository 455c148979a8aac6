import json
import time

import pytest
from pyspark.sql import functions as F

from riskloom.contract import CanaryParams, CostMatrix, MonitorParams, ReplayParams
from riskloom.operators import drift, rules
from riskloom.plans import rule_queries
from riskloom.sources import tables
from riskloom.streaming import bounded, matching, online, replay, scoring


def seconds(spark, times):
    return spark.createDataFrame([(i, int(t * 1_000_000)) for i, t in enumerate(times)], "id int, us bigint")


def _schedule(spark, offsets):
    return spark.createDataFrame([(i, i % 3, 1000 * i, x) for i, x in enumerate(offsets)], "id bigint, card bigint, us bigint, offset_s double")


def test_paced_replay(spark, tmp_path):
    """Events come out in the tick that reaches their offset, one without an offset never; a stopped replay goes on and repeats none."""
    offsets = [0.0, 0.5, 1.0, 1.01, 4.0, 4.0, None, 7.5]
    run, clock = replay.Replay(replay.by_offset(_schedule(spark, offsets)), f"{tmp_path}/out"), replay.step_clock(spark, 1.0)
    assert run.delivered() == (0, float("-inf"))
    first = run.finish(run.start(clock, f"{tmp_path}/checkpoint"), stop=lambda: run.delivered()[1] >= 1.0)
    assert 3 <= first <= 7
    again = replay.Replay(run.schedule, run.path)
    assert again.finish(again.start(clock, f"{tmp_path}/checkpoint")) == 7
    out = spark.read.schema("id bigint, offset_s double, batch bigint").parquet(f"{run.path}/events").collect()
    assert sorted(r["id"] for r in out) == [0, 1, 2, 3, 4, 5, 7] and all(r["batch"] >= r["offset_s"] for r in out)
    late = max(r["batch"] - r["offset_s"] for r in out if r["offset_s"] <= 1)
    assert late < 1 and len(list((tmp_path / "out" / "progress").glob("batch=*"))) <= 2
    assert run.finish(again.start(clock, f"{tmp_path}/checkpoint")) == 7  # nothing is left


def test_tick_that_is_run_again(spark, tmp_path):
    """A tick overwrites its own folder, by what was out before it."""
    run = replay.Replay(_schedule(spark, [0.0, 0.5, 1.5, 2.0]), f"{tmp_path}/out")
    at = lambda s: spark.createDataFrame([(int(s * 1e6),)], "us bigint").select(F.timestamp_micros("us").alias("timestamp"))
    for batch_id, s in ((0, 10), (1, 11), (1, 11.6), (2, 11.2), (4, 99)):
        run._run(at(s), batch_id)
    run._run(at(99).limit(0), 5)
    out = spark.read.schema("id bigint, batch bigint").parquet(f"{run.path}/events").collect()
    assert sorted((r["batch"], r["id"]) for r in out) == [(0, 0), (1, 1), (1, 2), (4, 3)] and run.delivered() == (4, 89.0)


def test_paced_replay_keeps_cards_in_order(spark, tmp_path):
    run = replay.Replay(_schedule(spark, [0.0] * 60), f"{tmp_path}/out")
    assert run.finish(run.start(replay.step_clock(spark, 1.0), f"{tmp_path}/checkpoint")) == 60
    files = spark.read.parquet(f"{run.path}/events/batch=0").select("card", "us", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    for card in range(3):
        mine = [r for r in files if r["card"] == card]
        assert len({r["file"] for r in mine}) == 1 and [r["us"] for r in mine] == sorted(r["us"] for r in mine) and len(mine) == 20


def test_replay_by_the_wall_clock(spark, tmp_path):
    """Half a second of offsets takes at least as long; nothing to replay is 0."""
    run, began = replay.Replay(_schedule(spark, [0.0, 0.2, 0.5]), f"{tmp_path}/out"), time.monotonic()
    assert run.finish(run.start(replay.wall_clock(spark), f"{tmp_path}/checkpoint", tick_s=0.2)) == 3
    assert time.monotonic() - began >= 0.5 and spark.read.parquet(f"{run.path}/events").count() == 3
    none = replay.Replay(run.schedule.limit(0), f"{tmp_path}/none")
    assert none.finish(none.start(replay.step_clock(spark, 1.0), f"{tmp_path}/c2")) == 0


def test_replay(spark):
    wait = lambda t, **o: [x["delay_s"] for x in replay.replay_delays(seconds(spark, t), **o).orderBy("id").collect()]
    assert wait([100, 110, 140], warp=10, max_wait_s=None) == [0, 1, 3]
    assert wait([0, 10, 1e6], warp=1, max_wait_s=5) == [0, 5, 5]
    with pytest.raises(ValueError):
        replay.replay_delays(seconds(spark, [0]), warp=0)


def test_label_schedule(spark):
    at = lambda t, **p: [x["label_offset_s"] for x in replay.label_schedule(seconds(spark, t), ReplayParams(jitter=0, **p)).orderBy("id").collect()]
    assert at([100, 110, 140], warp=10, max_wait_s=100, label_lag_days=0) == [0, 1, 4]
    assert at([0, 86400], warp=86400, max_wait_s=10, label_lag_days=2) == [2, 3]


def arrivals(spark, rows):
    """(side, id, t, value); a score of 0.5 or more was flagged."""
    made = [(k, i, float(t), float(v) if side == "s" else None, v >= 0.5 if side == "s" else None, int(v) if side == "l" else None) for k, (side, i, t, v) in enumerate(rows)]
    return spark.createDataFrame(made, "seq bigint, id string, t double, score double, decision boolean, label int")


def matched(spark, rows, retention=1800.0):
    got = matching.match_batch(arrivals(spark, rows), retention).collect()
    assert all(x["decision"] == (x["score"] >= 0.5) for x in got)
    return sorted((x["matched_seq"], x["id"], x["score"], x["label"]) for x in got)


def simulate(rows, retention):
    """One arrival after another; what is older than the clock less the retention is forgotten, matches too."""
    clock, waiting, closed, out = float("-inf"), {}, {}, []
    for k, (side, i, t, v) in enumerate(rows):
        clock = max(clock, t)
        waiting = {x: w for x, w in waiting.items() if w[1] >= clock - retention}
        closed = {x: at for x, at in closed.items() if at >= clock - retention}
        if t < clock - retention or i in closed:
            continue
        if i in waiting and waiting[i][0] != side:
            other = waiting.pop(i)[2]
            out.append((k, i, float(v if side == "s" else other), int(other if side == "s" else v)))
            closed[i] = t
        else:
            waiting[i] = (side, t, v)
    return sorted(out), sorted(("pending" if w[0] == "s" else "early", i) for i, w in waiting.items())


def test_matching(spark):
    last = lambda rows, *r: [x[1:] for x in matched(spark, rows, *r)]
    assert last([("s", "a", 0, 0.9), ("l", "a", 5, 1), ("l", "b", 5, 0), ("s", "b", 6, 0.1)]) == [("a", 0.9, 1), ("b", 0.1, 0)]
    assert last([("s", "a", 0, 0.9), ("l", "a", 5, 1), ("l", "a", 6, 0), ("s", "a", 7, 0.2)]) == [("a", 0.9, 1)]
    assert last([("s", "z", 1000, 0.5), ("s", "a", 0, 0.9), ("l", "a", 0, 1)], 2) == []
    assert last([("s", "a", 0, 0.9), ("s", "z", 10, 0.5), ("l", "a", 10, 1)], 2) == []
    assert last([("s", "a", 8, 0.9), ("s", "z", 10, 0.5), ("l", "a", 10, 1)], 2) == [("a", 0.9, 1)]
    again = [("s", "a", 0, 0.9), ("l", "a", 1, 1), ("s", "z", 50, 0.5), ("l", "a", 51, 0), ("s", "a", 52, 0.1)]
    assert last(again, 10) == [("a", 0.9, 1), ("a", 0.1, 0)] and last(again, 100) == [("a", 0.9, 1)]


def test_matching_against_simulation(spark):
    """Random arrivals with few ids that come back again and again; one of them has most rows."""
    import random

    for seed in range(4):
        r = random.Random(seed)
        pick = lambda: "hot" if r.random() < 0.6 else str(r.randrange(12))
        rows = [(r.choice("sl"), pick(), k // 2 - r.randrange(30), r.choice([0, 1])) for k in range(400)]
        expected, open_ = simulate(rows, 20.0)
        assert matched(spark, rows, 20.0) == expected and len(expected) > 20
        left = matching.waiting(arrivals(spark, rows), 20.0).collect()
        assert sorted((x["side"], x["id"]) for x in left) == open_
        assert matching.match_counts(arrivals(spark, rows), 20.0).first().asDict() == {"matched": len(expected), "pending": sum(x[0] == "pending" for x in open_)}
        newest = {max((x["seq"], x["id"]) for x in left if x["side"] == side)[1] for side in {x["side"] for x in left}}
        assert {x["id"] for x in matching.waiting(arrivals(spark, rows), 20.0, max_ids=1).collect()} == newest


def test_counts_fold_once(spark, monkeypatch):
    """The counts and what waits take one fold of the arrivals each, and ``max_ids`` bounds the count as it bounds what waits."""
    rows = [("s", str(k), k, 0.5) for k in range(9)] + [("l", "0", 9, 1)]
    folds = spark.sparkContext.accumulator(0)
    plain = matching._step

    def counted(known, *row):
        folds.add(1)
        return plain(known, *row)

    monkeypatch.setattr(matching, "_step", counted)
    assert matching.match_counts(arrivals(spark, rows), 100.0).first().asDict() == {"matched": 1, "pending": 8} and folds.value == 10
    assert len(matching.waiting(arrivals(spark, rows), 100.0, max_ids=3).collect()) == 3 and folds.value == 20
    assert matching.match_counts(arrivals(spark, rows), 100.0, max_ids=3).first()["pending"] == 3
    assert matching.match_counts(arrivals(spark, rows[:0]), 100.0).first().asDict() == {"matched": 0, "pending": 0}


def test_counts_all_that_wait(spark):
    """More scores wait than the monitor's bound on ids: each of them counts; of eight labels three make matches and five wait."""
    n = MonitorParams().max_ids + 7
    side = lambda ids, seq, score, label: ids.select(seq.alias("seq"), F.col("id").cast("string").alias("id"), F.lit(1.0).alias("t"), F.lit(score).cast("double").alias("score"), F.lit(label).cast("int").alias("label"))
    rows = side(spark.range(n + 3), F.col("id"), 0.5, None).union(side(spark.range(n, n + 8), F.col("id") + n, None, 1))
    assert matching.match_counts(rows, 100.0).first().asDict() == {"matched": 3, "pending": n}


def test_stream_matches_like_the_batch(spark, tmp_path):
    """In order of event time, one file after another: ids come back after the retention."""
    import random

    r = random.Random(5)
    rows = [(r.choice("sl"), str(r.randrange(8)), k * 3, r.choice([0, 1])) for k in range(120)]
    made = arrivals(spark, rows).withColumn("t", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        made.where(F.col("seq").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(src)
    stream = scoring.file_stream(spark, src, "seq bigint, id string, t timestamp, score double, decision boolean, label int", files_per_batch=1)
    q = matching.match_stream(stream, 60.0).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x["id"], x["score"], x["decision"], x["label"]) for x in spark.read.parquet(out).collect())
    assert got == sorted((i, s, s >= 0.5, y) for _, i, s, y in simulate(rows, 60.0)[0])


def test_stream_matcher_takes_many_ids_at_once():
    """A bucket of 3,000 ids costs as many exchanges with the state store as one of a single id; a waiting side goes on to the next batch."""
    import pandas as pd

    class Store:
        def __init__(self):
            self.value, self.timers, self.calls = None, [], 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                if name == "registerTimer":
                    self.timers.append(args[0])
                return {"getValueState": self, "exists": self.value is not None, "get": self.value, "listTimers": list(self.timers), "getCurrentWatermarkInMs": 0}.get(name)

            return call

    store, matcher = Store(), matching.Matcher(60.0)
    matcher.init(store)

    def batch(first, ids, **side):
        rows = {"seq": range(first, first + ids), "id": list(map(str, range(ids))), "t": pd.to_datetime([1000] * ids, unit="s"), "score": None, "decision": None, "label": None}
        return iter([pd.DataFrame(rows | side)])

    def run(rows):
        before = store.calls
        return sum(len(x) for x in matcher.handleInputRows((0,), rows, store)), store.calls - before

    assert run(batch(0, 3000, score=0.7, decision=True))[0] == 0
    matches, calls = run(batch(3000, 3000, label=1))
    assert matches == 3000 and calls <= 8
    assert run(batch(6000, 3000, label=0))[0] == run(batch(9000, 3000, score=0.1))[0] == 0  # all are closed


def bounded_version(rows, retention_ms, waiting):
    """One event after another, with a dictionary in order for each side: the front goes when it is too old or there are too many."""
    clock, held, out = 0, {"s": {}, "l": {}, "c": {}}, []
    limits = {"s": waiting, "l": waiting, "c": 5 * waiting}

    def put(side, i, entry):
        held[side].pop(i, None)
        held[side][i] = entry
        while len(held[side]) > limits[side]:
            held[side].pop(next(iter(held[side])))

    for k, (side, i, t, v) in enumerate(rows):
        clock = max(clock, t)
        oldest = clock - retention_ms
        for d in held.values():
            while d and next(iter(d.values()))[0] < oldest:
                d.pop(next(iter(d)))
        there = {x: d.pop(i) if i in d and d[i][0] < oldest else d.get(i) for x, d in held.items()}
        there = {x: e if e and e[0] >= oldest else None for x, e in there.items()}
        if t < oldest or there["c"]:
            continue
        other = "l" if side == "s" else "s"
        if there[other]:
            held[other].pop(i)
            out.append((k, i, float(v if side == "s" else there[other][1]), int(v if side == "l" else there[other][1])))
            put("c", i, (t, None))
        else:
            put(side, i, (t, v))
    return out


@pytest.mark.parametrize(("shards", "max_ids"), [(1, 6), (1, 10_000), (3, 9)])
def test_bounded_stream_against_one_event_after_another(spark, tmp_path, shards, max_ids):
    """More ids wait than the bound; batches cut the order anywhere; each shard is as if alone."""
    import random

    r = random.Random(max_ids)
    rows = [(r.choice("ssl"), str(r.randrange(40)), (k * 2 - r.randrange(12)) * 1000 + 1_700_000_000_000, r.choice([0, 1])) for k in range(400)]
    made = [(k, "score" if s == "s" else "label", i, t, float(v) if s == "s" else None, v >= 0.5 if s == "s" else None, v if s == "l" else None, None) for k, (s, i, t, v) in enumerate(rows)]
    df = spark.createDataFrame(made, "seq bigint, kind string, id string, ms bigint, score double, decision boolean, label int, payload string").withColumn("t", F.timestamp_millis("ms")).drop("ms")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        df.where(F.col("seq").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(src)
    stream = scoring.file_stream(spark, src, df.schema, files_per_batch=1)
    found = bounded.match_events(stream, 120.0, max_ids, shards)
    found.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x["seq"], x["id"], x["score"], x["label"]) for x in spark.read.parquet(out).where("kind = 'match'").collect())
    shard = {x["id"]: x["s"] for x in df.select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).distinct().collect()}
    expected = []
    for s in range(shards):
        mine = [(k, *row) for k, row in enumerate(rows) if shard[row[1]] == s]
        expected += [(mine[k][0], i, score, y) for k, i, score, y in bounded_version([m[1:] for m in mine], 120_000, -(-max_ids // shards))]
    assert got == sorted(expected) and len(got) > 30
    if max_ids < 10:
        assert sorted(expected) != sorted(simulate([(s, i, t / 1000, v) for s, i, t, v in rows], 120.0)[0])  # the bound matters here


def test_velocity_parts(spark, tmp_path):
    """Cards with dense and sparse times, nulls, ties and late events, over batches: the rows of a loop over what has come."""
    import random

    r = random.Random(4)
    window, batches = 1000, []
    for b in range(4):
        rows = [(b * 1000 + k, r.choice(["hot", "hot", "a", "b"]), b * 900 + r.randrange(950), None if r.random() < 0.1 else float(r.randrange(1, 50))) for k in range(120)]
        batches.append(rows)
        spark.createDataFrame(rows, "id bigint, card string, us bigint, amount double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = scoring.file_stream(spark, str(tmp_path / "in"), "id bigint, card string, us bigint, amount double", files_per_batch=1)
    out = str(tmp_path / "out")
    online.velocity_stream(stream, window).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {x["id"]: (x["v_count"], x["v_sum"], x["v_max"]) for x in spark.read.parquet(out).collect()}
    known = []
    for rows in batches:
        known += [x for x in rows if x[3] is not None]
        for i, card, us, _ in rows:
            seen = [a for _, c, t, a in known if c == card and us - window <= t < us]
            newest = max((t for _, c, t, _ in known if c == card), default=0)
            if us - window >= newest - 2 * window:  # all that it asks for is still kept
                assert got[i] == (len(seen), sum(seen), max(seen, default=0.0)), i
    assert len(got) == 480


def test_cards_of_a_bucket_share_their_state(spark, tmp_path):
    """Many cards, a missing one among them, in few buckets: the state has entries for parts of buckets, not for cards, and the rows are those of a loop."""
    window, batches = 1000, [[(b * 1000 + k, k % 100 or None, 1 + b * 500 + k // 100 * 60 + k % 7, float(k % 13)) for k in range(600)] for b in range(2)]
    for rows in batches:
        spark.createDataFrame(rows, "id bigint, card bigint, us bigint, amount double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = scoring.file_stream(spark, str(tmp_path / "in"), "id bigint, card bigint, us bigint, amount double", files_per_batch=1)
    out, every = str(tmp_path / "out"), [x for rows in batches for x in rows]
    run = online.velocity_stream(stream, window, buckets=2).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    entries = max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"])
    assert 0 < entries < 100 * 2
    got = {x["id"]: (x["v_count"], x["v_sum"], x["v_max"]) for x in spark.read.parquet(out).collect()}
    assert len(got) == 1200
    for i, card, us, _ in every:
        seen = [a for _, c, t, a in every if c == card and us - window <= t < us]
        assert got[i] == (len(seen), sum(seen), max(seen, default=0.0)), i


def test_monitor_keeps_no_history(spark, tmp_path):
    """A cycle reads the windows of the one before; those of older cycles are gone, and a replayed cycle leaves the same rows."""
    folder, run = str(tmp_path), None
    baseline = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    params = MonitorParams(window=40, min_current=20, min_matched=10, debounce=2, psi=0.2, auprc_floor=0.99)
    run = online.monitor_batches(folder, baseline, ["x"], params)
    schema = "kind string, seq bigint, id string, score double, decision boolean, label int, payload string"

    def batch(k):
        scored = [("scored", 100 * k + i, str(i), 0.5, None, None, json.dumps({"x": float(i if k < 2 else 500 + i)})) for i in range(30)]
        return spark.createDataFrame(scored + [("match", 100 * k + 50 + i, str(i), i / 30, i > 15, i % 2, None) for i in range(30)] + [("poison", 1, None, None, None, None, None)] * k, schema)

    for k in (0, 1, 2, 3, 3):
        run(batch(k), k)
    cycles = {x["cycle"]: x for x in spark.read.parquet(f"{folder}/cycles").collect()}
    assert [(cycles[k]["matched"], cycles[k]["poison"]) for k in range(4)] == [(30, 0), (40, 1), (40, 2), (40, 3)]
    assert cycles[0]["max_psi"] < cycles[2]["max_psi"] and cycles[3]["max_psi"] > 0.2
    fired = sorted((x["cycle"], x["kind"]) for x in spark.read.parquet(f"{folder}/alerts").collect())
    assert fired == [(1, "concept_drift"), (1 if cycles[0]["max_psi"] > 0.2 and cycles[1]["max_psi"] > 0.2 else 3, "data_drift")]
    import os
    assert {name: sorted(x for x in os.listdir(f"{folder}/{name}") if x.startswith("batch")) for name in ("matches", "features", "latches")} == dict.fromkeys(("matches", "features", "latches"), ["batch=2", "batch=3"])


def test_rolling(spark):
    rows = [(str(i), s, s >= 0.5, y, i) for i, (s, y) in enumerate([(0.1, 1), (0.9, 0), (0.9, 1)])]
    m = spark.createDataFrame(rows, "id string, score double, decision boolean, label int, matched_seq bigint")
    got = matching.rolling_metrics(m, CostMatrix(100, 5)).first()
    assert got["matched"] == 3 and got["cost"] == pytest.approx(35) and got["flagged_rate"] == pytest.approx(2 / 3)
    assert matching.rolling_metrics(m.withColumn("decision", ~F.col("decision")), CostMatrix(100, 5)).first()["cost"] == pytest.approx(100 / 3)
    assert matching.rolling_metrics(m, window=2).first()["matched"] == 2
    empty = matching.rolling_metrics(m.where("false")).first()
    assert empty["matched"] == 0 and empty["auprc"] is None
    assert matching.feature_window(m, 2, 5, "matched_seq") is None


def test_decode_reasons(spark):
    good = {"transaction_id": "1", "card_id": "c", "amount": 5.0, "event_timestamp": "t", "raw": {"C1": 1.0, "v": {"V1": 2.0}, "categorical": {"M1": "T"}}}
    cases = [(json.dumps(good), None), (None, "empty_payload"), ("", "empty_payload"), ("{", "deserialize_error"), (json.dumps(good | {"amount": 0}), "rejected"), (json.dumps(good | {"amount": 2e6}), "rejected"), (json.dumps(good | {"transaction_id": "x" * 129}), "rejected"), (json.dumps(good | {"raw": {"v": {"V1": "NaN"}}}), "rejected"), (json.dumps(good | {"raw": {"categorical": {"a": "x" * 257}}}), "rejected"), (json.dumps(good | {"raw": {"v": {str(i): 1.0 for i in range(257)}}}), "rejected")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, value string")
    assert [x["reason"] for x in scoring.decode(df).orderBy("i").collect()] == [r for _, r in cases]


def test_scoring_stream_restarts(spark, tmp_path):
    src, good, dead, ck = (str(tmp_path / x) for x in ("in", "good", "dead", "ck"))
    schema = "value string"
    body = lambda i: json.dumps({"transaction_id": str(i), "card_id": "c", "amount": float(i)})
    run = scoring.score_and_route(good, dead, lambda g: g.select("event.transaction_id", (F.col("event.amount") / 10).alias("score")))
    for first in (1, 4):
        spark.createDataFrame([(body(i),) for i in range(first, first + 3)] + [("{",)], schema).write.mode("append").parquet(src)
        scoring.start_scoring(scoring.file_stream(spark, src, schema), ck, run).awaitTermination()
    assert sorted(x["transaction_id"] for x in spark.read.parquet(good).collect()) == list("123456")
    assert [x["reason"] for x in spark.read.parquet(dead).collect()] == ["deserialize_error"] * 2


def test_outcomes_and_breaker(spark):
    df = spark.createDataFrame([(200,), (503,), (429,), (400,), (401,), (302,), (None,)], "s int")
    assert [x[0] for x in df.select(scoring.outcome(F.col("s"))).collect()] == ["ok", "unavailable", "throttled", "rejected", "unavailable", "rejected", "unavailable"]
    now = [0.0]
    b = scoring.CircuitBreaker(3, 10, lambda: now[0])
    for _ in range(3):
        assert b.allows()
        b.record(False)
    assert not b.allows()
    now[0] = 10
    assert b.allows() and not b.allows()
    b.record(True)
    assert b.allows()


def test_alerts_and_retraining(spark):
    rows = [(0, 0.3, 0.2, 300), (1, 0.3, 0.2, 300), (2, None, 0.2, 300), (3, 0.3, 0.5, 300), (4, 0.3, 0.2, 100)]
    df = spark.createDataFrame(rows, "cycle int, max_psi double, auprc double, matched int")
    got = {(x["cycle"], x["kind"]) for x in scoring.alerts(df, MonitorParams(debounce=3)).collect()}
    assert got == {(3, "data_drift"), (2, "concept_drift")}
    fired = []
    clock = [0.0]
    gate = scoring.RetrainGate(60, fired.append, lambda: clock[0])
    assert gate.handle({}) and not gate.handle({})
    clock[0] = 60
    assert gate.handle({}) and len(fired) == 2

    def broken(_):
        raise RuntimeError

    gate = scoring.RetrainGate(60, broken, lambda: 0.0)
    with pytest.raises(RuntimeError):
        gate.handle({})
    assert gate.last is None
    times = scoring.retrain_times(spark.createDataFrame([(0.0,), (10.0,), (70.0,)], "at_s double"), 60)
    assert sorted(x[0] for x in times.collect()) == [0, 70]


def test_counters(spark):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in ((0, 5), (10, 8), (20, 2), (400, 3))], "s string, ts_s bigint, value double")
    got = [x["increase"] for x in rules.increase(df, ["s"], 300).orderBy("ts_s").collect()]
    assert got == [0, 3, 5, 1]
    q = spark.createDataFrame([("a", 0.1, 50), ("a", 0.2, 90), ("a", float("inf"), 100), ("b", 0.1, 0), ("b", float("inf"), 0)], "s string, le double, count bigint")
    got = {x["s"]: x["quantile"] for x in rules.histogram_quantile(q, ["s"], 0.7).collect()}
    assert got == {"a": pytest.approx(0.15), "b": None}
    assert rules.histogram_quantile(q, ["s"], 0.99).where("s = 'a'").first()["quantile"] == 0.2


def test_every_rule_evaluates(spark):
    rows = [("svc", t, r.metric, dict(r.labels and (("status", "500"), ("reason", "integrity"))) | ({"le": le} if r.kind == "quantile" else {}), float(t)) for r in rules.ALERT_RULES for t in range(0, 1200, 60) for le in (("0.01", "Infinity") if r.kind == "quantile" else ("",))]
    series = spark.createDataFrame(rows, "service string, ts_s bigint, metric string, labels map<string,string>, value double").dropDuplicates(["service", "ts_s", "metric"])
    for rule in rules.ALERT_RULES:
        out = rules.evaluate(rule, series)
        assert {"service", "ts_s", "value", "active", "firing"} <= set(out.columns)
    drift = next(r for r in rules.ALERT_RULES if r.name == "feature_drift")
    got = {x["ts_s"]: (x["active"], x["firing"]) for x in rules.evaluate(drift, series).collect()}
    assert got[0] == (False, False) and got[60] == (True, False) and got[120] == (True, True)


def test_series_laid_out_by_service_are_not_shuffled_again(spark):
    """Whatever its kind, a rule without a guard adds no exchange to that of the layout."""
    rows = spark.range(100).selectExpr("cast(id % 3 as string) service", "id ts_s", "map('le', cast(id as string), 'reason', 'transient') labels", "cast(id as double) value").repartition(4, "service")
    for name in ("fast_budget_burn", "auth_rejections", "latency_slo", "feature_drift", "reload_stalled"):
        rule = next(r for r in rules.ALERT_RULES if r.name == name)
        plan = rules.evaluate(rule, rows.withColumn("metric", F.lit(rule.metric))).groupBy("service").agg(F.count_if("firing"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0, name


def test_rule_series_of_unknown_categories(spark):
    """Events without a category are a series of their own: part of the total, never bad."""
    rule = next(r for r in rules.ALERT_RULES if r.name == "auth_rejections")
    rows = [("s", "0", t, 1.0, c) for t, cs in enumerate((("error", None, "click"), (None, "click"), ("error",))) for c in cs]
    t = spark.createDataFrame(rows, "service string, endpoint string, ts_s bigint, amount double, category string")
    got = {x["ts_s"]: x["value"] for x in rules.evaluate(rule, rule_queries._series(rule, rule_queries._per_second(t))).collect()}
    assert got == {0: None, 1: 0.0, 2: pytest.approx(1 / 3)}


def test_rule_limits_follow_params():
    by = {r.name: r for r in rules.ALERT_RULES}
    assert by["feature_drift"].limit == MonitorParams().psi and by["performance_decay"].limit == MonitorParams().auprc_floor


def test_canary(spark):
    p = CanaryParams()
    base = dict(p99_s=0.01, error_rate=0.0, samples=1000, agreement=0.99, auprc_ratio=1.0, final=False)
    cases = [({}, "promote"), ({"p99_s": 0.08}, "rollback"), ({"samples": 10}, "hold"), ({"agreement": 0.5}, "rollback"), ({"auprc_ratio": 0.5}, "rollback"), ({"final": True, "auprc_ratio": None}, "hold"), ({"samples": 10, "error_rate": 0.1}, "rollback")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], "p99_s double, error_rate double, samples bigint, agreement double, auprc_ratio double, final boolean")
    assert [x[0] for x in df.select(rules.canary_decision(p)).collect()] == [d for _, d in cases]
    weights = []
    assert rules.run_canary(p, lambda w: "promote", weights.append) == "promoted" and weights == [0.05, 0.25, 1.0]
    weights.clear()
    assert rules.run_canary(CanaryParams(max_holds=2), lambda w: "hold", weights.append) == "rollback" and weights == [0.05, 0.0]
    turns = iter(["hold", "promote", "hold", "promote", "promote"])
    assert rules.run_canary(CanaryParams(max_holds=1), lambda w: next(turns), weights.append) == "promoted"


def test_token_bucket(spark):
    df = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate([("a", 0.0)] * 5 + [("a", 1.0)] * 3 + [("b", 0.0)])], "client string, at_s double, id int")
    got = {x["client"]: (x["allowed"], x["denied"]) for x in rules.token_bucket(df, capacity=3, refill=1).collect()}
    assert got == {"a": (4, 4), "b": (1, 0)}


def test_token_bucket_against_a_loop(spark):
    """Random requests, one client with nine of ten."""
    import random

    r = random.Random(2)
    rows = [("hot" if r.random() < 0.9 else r.choice("ab"), r.randrange(2000) / 4, i) for i in range(600)]
    state, expected = {}, {}
    for c, t, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        tokens, last = state.get(c, (3.0, t))
        tokens = min(3.0, tokens + (t - last) * 0.5)
        ok = tokens >= 1
        state[c] = (tokens - ok, t)
        a, b = expected.get(c, (0, 0))
        expected[c] = (a + ok, b + (not ok))
    got = {x["client"]: (x["allowed"], x["denied"]) for x in rules.token_bucket(spark.createDataFrame(rows, "client string, at_s double, id int"), capacity=3, refill=0.5).collect()}
    assert got == expected


def test_cooldown_against_a_loop(spark):
    """A key with nine of ten rows, null keys, equal times."""
    import random

    r = random.Random(1)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", None]), float(r.randrange(900))) for _ in range(700)] + [("a", None), ("b", 5.0)]
    expected = set()
    for k in {k for k, _ in rows}:
        last = None
        for t in sorted(t for x, t in rows if x == k and t is not None):
            if last is None or t - last >= 7:
                expected.add((k, t))
                last = t
    got = [(x["k"], x["at"]) for x in drift.cooldown(spark.createDataFrame(rows, "k string, at double"), by="k", at_s="at", seconds=7.0).collect()]
    assert len(got) == len(expected) and set(got) == expected


def guarded(spark, name, samples):
    """How a rule stands at each time, for samples (metric, labels, t, value)."""
    rule = next(r for r in rules.ALERT_RULES if r.name == name)
    series = spark.createDataFrame([("s", m, lab, t, float(v)) for m, lab, t, v in samples], "service string, metric string, labels map<string,string>, ts_s bigint, value double")
    return {x["ts_s"]: (x["value"], x["active"]) for x in rules.evaluate(rule, series).collect()}


def test_guards(spark):
    low = [("auprc", {}, t, 0.1) for t in (0, 60, 120)]
    assert not guarded(spark, "performance_decay", low)[120][1]  # nothing matched yet
    got = guarded(spark, "performance_decay", low + [("matched", {}, 0, 200), ("matched", {}, 60, 201)])
    assert [got[t][1] for t in (0, 60, 120)] == [False, True, True]
    lag = [("join_clock_lag", {}, t, 700) for t in (0, 60, 120, 600)]
    idle = [("scored", {}, t, 5) for t in (0, 60, 120)]
    assert not any(x[1] for x in guarded(spark, "join_clock_stalled", lag + idle).values())
    got = guarded(spark, "join_clock_stalled", lag + idle[:2] + [("scored", {}, 120, 6)])
    assert [got[t][1] for t in (0, 60, 120, 600)] == [False, False, True, False]  # stale after five minutes
    fetches = [("feature_fetch_count", {"endpoint": e}, t, t * 2) for e in "ab" for t in (0, 60, 120)]
    errors = [("feature_fetch_errors", {}, t, v) for t, v in ((0, 0), (60, 2), (120, 5))]
    got = guarded(spark, "feature_fetch_errors", fetches + errors)
    assert got[60] == (pytest.approx(2 / 240), False) and got[120] == (pytest.approx(5 / 480), True)
    few = [("feature_fetch_count", {}, t, t // 60) for t in (0, 60, 120)]
    assert not guarded(spark, "feature_fetch_errors", few + errors)[120][1]  # too few fetches a second


def test_quantile_of_two_series(spark):
    """Series of other labels are no resets of each other."""
    one = [("latency", {"endpoint": e, "le": le}, t, c * t) for e in "ab" for le, c in (("0.01", 1), ("0.1", 2), ("Infinity", 2)) for t in (0, 60, 120)]
    value, active = guarded(spark, "latency_slo", one)[120]
    assert value == pytest.approx(0.01 + 0.09 * 0.98) and active


def test_log_sinks(spark, tmp_path):
    assert scoring.kafka_options("b:1", "t") == {"kafka.bootstrap.servers": "b:1", "subscribe": "t", "includeHeaders": "true", "failOnDataLoss": "true", "startingOffsets": "earliest"}
    assert scoring.kafka_options("b:1", "t", start="latest")["startingOffsets"] == "latest"
    rewound = scoring.kafka_options("b:1", "t", since_ms=5)
    assert rewound["startingTimestamp"] == "5" and rewound["startingOffsetsByTimestampStrategy"] == "latest" and "startingOffsets" not in rewound
    with pytest.raises(ValueError):
        scoring.kafka_options("b:1", "t", start="middle")
    assert scoring.CONFIRMED["kafka.enable.idempotence"] == "true" and scoring.CONFIRMED["kafka.acks"] == "all"
    body = lambda i: json.dumps({"transaction_id": str(i), "card_id": f"c{i}", "amount": float(i)})
    spark.createDataFrame([("k1", body(1)), ("k2", "{"), (None, "")], "key string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    sent, failures = [], [True]

    def send(rows, servers, topic):
        if topic == "good" and failures:
            failures.pop()
            raise RuntimeError("not confirmed")
        sent.extend((topic, x["key"], x["value"], [(h["key"], bytes(h["value"])) for h in x["headers"] or []]) for x in rows.collect())

    run = scoring.score_to_log("b:1", "good", "dead", lambda g: g.select("event.card_id", (F.col("event.amount") / 10).alias("score")), send=send)
    stream = lambda: scoring.file_stream(spark, str(tmp_path / "in"), "key string, value string")
    with pytest.raises(Exception, match="not confirmed"):
        scoring.start_scoring(stream(), str(tmp_path / "ck"), run).awaitTermination()
    assert not any(x[0] == "good" for x in sent)
    sent.clear()  # what isn't confirmed is sent again, dead letters too
    scoring.start_scoring(stream(), str(tmp_path / "ck"), run).awaitTermination()
    assert sorted(sent, key=repr) == sorted([("good", "c1", '{"card_id":"c1","score":0.1}', []), ("dead", "k2", "{", [("reason", b"deserialize_error")]), ("dead", None, "", [("reason", b"empty_payload")])], key=repr)


def test_inference_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), (None, 0.1)], "transaction_id string, score double")
    assert scoring.log_inference(rows, str(tmp_path / "log"), 0) and spark.read.parquet(str(tmp_path / "log")).count() == 1
    (tmp_path / "file").write_text("")
    assert not scoring.log_inference(rows, str(tmp_path / "file"), 1)


def test_retry_after(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("5",), ("-3",), ("1e3",), ("Wed, 01 May 2024 12:00:07 GMT",), ("Wed, 01 May 2024 11:00:00 GMT",), ("soon",), (None,)], "h string")
    assert [x[0] for x in df.select(scoring.retry_after_s(F.col("h"), now)).collect()] == [5, 0, 1000, 7, 0, None, None]
    assert [x[0] for x in df.select(scoring.shed_delay_s(F.col("h"), now)).collect()] == [5, 0.5, 30, 7, 0.5, 0.5, 0.5]


def test_inhibition(spark):
    df = spark.createDataFrame([("x", "fast"), ("x", "slow"), ("y", "slow")], "service string, alertname string")
    assert sorted(tuple(x) for x in rules.inhibit(df, "fast", "slow", ["service"]).select("service", "alertname").collect()) == [("x", "fast"), ("y", "slow")]


def test_files(spark, tmp_path):
    p = str(tmp_path / "x.json")
    tables.write_json({"a": [1]}, p)
    assert tables.read_json(p) == {"a": [1]} and tables.read_json(str(tmp_path / "no"), {}) == {}
    url = f"file://{tmp_path}/deep/er/y.json"
    assert tables.read_json(url, {"none": 0}) == {"none": 0}
    for value in ({"a": "ü\n"}, [1, 2]):  # the second takes the first's place
        tables.write_json(value, url)
        assert tables.read_json(url, {}) == value
    assert [f.name for f in (tmp_path / "deep" / "er").iterdir() if not f.name.endswith(".crc")] == ["y.json"]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n")
    assert [x["b"] for x in tables.read_csv(spark, str(tmp_path / "c.csv"), "a int, b string", ["b"]).collect()] == ["x", "y"]
    tables.write_table(spark.range(3).select(F.col("id").alias("V1"), F.lit(1).alias("Vx")), str(tmp_path / "t"))
    assert tables.matching_columns(spark, str(tmp_path / "t")) == ["V1"]
    assert tables.content_hashes(spark, str(tmp_path / "c.csv")).first()["sha256"] == tables.bytes_hash(b"a,b\n1,x\n2,y\n")
    with pytest.raises(KeyError):
        tables.read_columns(spark, str(tmp_path / "t"), ["nope"])


def test_shard_exchanges_do_not_grow_with_events():
    """3,000 ids of a shard cost a few hundred exchanges with the state store, not several for each id; their labels then match."""
    import pandas as pd

    calls = []

    class Store(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: calls.append(0) or self.__setitem__("v", v)
        containsKey = lambda self, k: calls.append(0) or k in self
        getValue = lambda self, k: calls.append(0) or self[k]
        updateValue = lambda self, k, v: calls.append(0) or self.__setitem__(k, v)
        removeKey = lambda self, k: calls.append(0) or self.__delitem__(k)
        getMapState = getValueState = lambda self, *_: Store()
        listTimers = lambda self: []
        registerTimer = lambda self, _: None
        getCurrentWatermarkInMs = lambda self: 0

    matcher, times = bounded.ShardMatcher(60.0, {"score": 10_000, "label": 10_000, "closed": 50_000}), Store()
    matcher.init(times)

    def run(kind, first, **values):
        rows = {"kind": kind, "seq": range(first, first + 3000), "id": list(map(str, range(3000))), "t": pd.to_datetime([1000] * 3000, unit="s"), "score": None, "decision": None, "label": None, "payload": None}
        before = len(calls)
        return sum(len(x) for x in matcher.handleInputRows((0,), iter([pd.DataFrame(rows | values)]), times)), len(calls) - before

    assert run("score", 0, score=0.5, decision=True)[0] == 0
    matches, exchanges = run("label", 3000, label=1)
    assert matches == 3000 and exchanges < 500
