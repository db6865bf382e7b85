"""Streams with state: any order of arrival gives the batch's rows, and finished keys leave nothing behind."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import iterative_cut
from parlance.streaming import jobs, states

NOON = datetime(2024, 1, 1, 12)


class Feed:
    """A stream of JSON files, put in one by one."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        self.checkpoint = str(folder / "c")
        self.stream = lambda: made(source).writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append").option("checkpointLocation", self.checkpoint).start()

    def put(self, rows):
        self.n += 1
        (self.folder / "in" / f"{self.n:03}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def run(self):
        """Everything put in so far, by a query that begins where the last one ended."""
        q = self.stream()
        q.processAllAvailable()
        q.stop()
        return self.spark.read.parquet(str(self.folder / "out")).collect()


def at(minutes):
    return (NOON + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")


def parts_of(recording, total, gap, minutes):
    said = [(i * gap, i * gap + gap - 100, "S01", f"s{i}") for i in range(total // gap)]
    hear = lambda a, b: [(max(s, a) - a, min(e, b) - a, w, t) for s, e, w, t in said if s < b and e > a]
    want, rows = list(iterative_cut.plan(total, hear, 6000)), []
    for p in want:
        a, b = p["start_abs_ms"], p["start_abs_ms"] + p["duration_ms"]
        segments = [{"start_ms": s, "end_ms": e, "speaker": w, "text": t} for s, e, w, t in hear(a, b)]
        rows.append({"recording_id": recording, "ts": at(minutes + p["part"]), "part": p["part"], "start_ms": a, "duration_ms": p["duration_ms"], "total_ms": total, "segments": segments})
    return rows, [(recording, p["part"], p["status"], p["end_cut_abs_ms"]) for p in want]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_and_repeated_parts_give_the_batch_rows(spark, tmp_path, seed):
    rng, rows, want = random.Random(seed), [], []
    for recording in range(6):
        mine, expected = parts_of(recording, rng.choice([500, 20_000, 36_000]), rng.choice([700, 900]), 0)
        rows, want = rows + mine, want + expected
    rows += rng.sample(rows, 8)
    rng.shuffle(rows)
    feed = Feed(spark, tmp_path, states.PARTS, states.cut_states)
    half = len(rows) // 2
    for k in range(0, half, 7):
        feed.put(rows[k : min(k + 7, half)])
    feed.run()
    for k in range(half, len(rows), 7):
        feed.put(rows[k : k + 7])
    got = sorted((r.recording_id, r.part, r.status, r.cut_ms) for r in feed.run())
    assert got == sorted(want)


def test_ended_and_stalled_recordings_leave_no_state(spark, tmp_path):
    rows, want = parts_of(1, 20_000, 900, 0)
    feed = Feed(spark, tmp_path, states.PARTS, lambda s: states.cut_states(s, "1 minute", 600_000, 600_000))
    feed.put(rows[::-1])
    feed.put([dict(rows[1], recording_id=2)])  # its part 0 never comes
    feed.run()
    other = dict(rows[0], recording_id=3, ts=at(90))
    feed.put([other])
    feed.put([dict(other, recording_id=4, ts=at(95))])
    feed.run()
    feed.put([dict(rows[0], ts=at(1))])  # behind the watermark: a finished recording doesn't begin again
    feed.put([dict(other, recording_id=5, ts=at(96))])
    out = feed.run()
    assert sorted((r.recording_id, r.part, r.status, r.cut_ms) for r in out if r.recording_id == 1) == want
    assert [(r.part, r.status, r.cut_ms) for r in out if r.recording_id == 2] == [(0, "stalled", 0)]
    for name in ("progress", "clock"):
        left = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", name).load()
        assert {r[0] for r in left.select(F.col("key.recording_id")).collect()} <= {3, 4, 5}
    early = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", "early").load()
    assert early.count() == 0


def test_an_anchor_near_the_start_starts_the_next_part_at_zero():
    parts = list(iterative_cut.plan(30_000, lambda a, b: [(0, 100, "S01", "short"), (200, 5900, "S01", "long")] if a == 0 and b == 6000 else [], 6000))
    assert parts[0]["end_cut_abs_ms"] == 100 and parts[1]["start_abs_ms"] == 0


def log_status(events):
    """A job's status by its whole log."""
    out = {}
    order = {k: i for i, k in enumerate([*jobs.MOVES, "delete"])}
    for e in sorted(events, key=lambda e: (e["ts"], order[e["kind"]])):
        status = out.get(e["job_id"])
        allowed, to = ((status,), "deleted") if e["kind"] == "delete" else jobs.MOVES[e["kind"]]
        out[e["job_id"]] = to if status in allowed else status
    return out


def test_a_job_has_the_status_of_its_log_in_any_order(spark, tmp_path):
    rng, events = random.Random(4), []
    for j in range(12):
        kinds = ["upload", "start", rng.choice(["finish", "fail"])][: rng.randint(1, 3)] + (["delete"] if j % 5 == 0 else [])
        events += [{"job_id": f"j{j}", "ts": at(rng.randint(0, 2) + 3 * k), "kind": kind, "detail": f"result {j}"} for k, kind in enumerate(kinds)]
    rng.shuffle(events)
    feed = Feed(spark, tmp_path, jobs.EVENTS, lambda s: states.job_states(s, 3_600_000, "30 minutes"))
    for k in range(0, len(events), 5):
        feed.put(events[k : k + 5])
    feed.put([{"job_id": "clock", "ts": at(60), "kind": "upload"}])
    feed.run()
    feed.put([{"job_id": "clock", "ts": at(61), "kind": "start"}])
    rows = feed.run()
    want = log_status(events)
    last = {}
    for r in sorted(rows, key=lambda r: r.n_events):
        last[r.job_id] = r.status
    assert {k: v for k, v in last.items() if k != "clock"} == want
    polled = {r.job_id: r for r in states.job_table(spark, feed.checkpoint).collect()}
    assert {k: r.status for k, r in polled.items() if k != "clock"} == want
    done = next(k for k, v in want.items() if v == "done")
    assert polled[done].result == f"result {done[1:]}"
    for minutes in (400, 401, 402):
        feed.put([{"job_id": "clock", "ts": at(minutes), "kind": "start"}])
        feed.run()
    assert all(r.status in ("queued", "processing") for r in states.job_table(spark, feed.checkpoint).collect())


class Calls:
    """Named state in memory that counts what is asked of it."""

    def __init__(self):
        self.n, self.held = 0, {}

    def getValueState(self, name, schema):
        return self._state(name, None)

    def getListState(self, name, schema):
        return self._state(name, [])

    def getMapState(self, name, key_schema, value_schema):
        return self._state(name, {})

    def registerTimer(self, at):
        self.n += 1

    deleteTimer = registerTimer

    def getCurrentWatermarkInMs(self):
        return 10**9

    def _state(self, name, empty):
        calls, held = self, self.held
        held[name] = empty

        class State:
            def __getattr__(self, what):
                def call(*args):
                    calls.n += 1
                    now = held[name]
                    if what == "get":
                        return now if not isinstance(now, list) else iter(now)
                    if what == "exists":
                        return now not in (None, [])
                    if what == "update":
                        held[name] = args[0]
                    elif what == "clear":
                        held[name] = None if empty is None else type(empty)()
                    elif what in ("appendList", "appendValue"):
                        now.extend(args[0] if what == "appendList" else args)
                    elif what == "containsKey":
                        return args[0] in now
                    elif what == "getValue":
                        return now[args[0]]
                    elif what == "updateValue":
                        now[args[0]] = args[1]
                    elif what == "removeKey":
                        del now[args[0]]
                    elif what == "keys":
                        return iter(list(now))

                return call

        return State()


def test_a_batch_costs_a_key_few_calls_however_many_rows(spark):
    from pyspark.sql import Row

    calls, text = Calls(), states._Text(1000, 1000)
    text.init(calls)
    pieces = [Row(at=n, n=n, piece=f"<{n}>", last=n == 199) for n in range(200)]
    assert list(text.handleInputRows(("a",), iter(pieces[:150][::-1]), calls)) == []
    (done,) = text.handleInputRows(("a",), iter(pieces[100:]), calls)
    assert done.text == "".join(p.piece for p in pieces) and done.n_pieces == 200 and calls.n < 30
    calls, job = Calls(), states._Jobs(1000)
    job.init(calls)
    events = [Row(at=t, kind="start" if t else "upload", detail=None) for t in range(200)]
    (row,) = job.handleInputRows(("j",), iter(events[::-1]), calls)
    assert (row.status, row.n_events, row.ts_ms) == ("processing", 200, 199) and calls.n < 15


def test_waiting_pieces_and_the_streams_of_a_bucket_cost_no_call_each(spark):
    from pyspark.sql import Row

    calls, text = Calls(), states._Text(1000, 1000)
    text.init(calls)
    pieces = [Row(stream_id=f"s{k}", at=n, n=n, piece=f"<{k}.{n}>", last=n == 19) for k in range(50) for n in range(20)]
    assert list(text.handleInputRows((0,), iter([p for p in pieces if p.n][::-1]), calls)) == [] and calls.n < 10
    done = list(text.handleInputRows((0,), iter([p for p in pieces if not p.n]), calls))
    assert {r.stream_id: r.text for r in done} == {f"s{k}": "".join(f"<{k}.{n}>" for n in range(20)) for k in range(50)}
    assert list(text.handleInputRows((0,), iter(pieces[:40]), calls)) == [] and calls.n < 20


def test_streams_of_one_bucket_end_each_at_its_own_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, states.PIECES, lambda s: states.token_texts(s, "5 minutes", 600_000, 600_000, buckets=1))
    piece = lambda stream, minute, n, last=False: {"stream_id": stream, "ts": at(minute), "n": n, "piece": f"{stream}{n}", "last": last}
    batches = [
        [piece("a", 0, 0), piece("b", 0, 1, True), piece("c", 0, 0), piece("c", 0, 2), piece(None, 0, 0)],
        [piece("b", 1, 0), piece("a", 1, 0), piece("c", 14, 3, True), piece(None, 1, 1, True)],
        [piece("clock", 18, 1)],
        [piece("c", 19, 1)],
    ]
    for batch in batches:
        feed.put(batch)
        out = feed.run()
    assert sorted((r.stream_id or "", r.status, r.n_pieces, r.text) for r in out) == [("", "done", 2, "None0None1"), ("a", "stalled", 1, "a0"), ("b", "done", 2, "b0b1"), ("c", "done", 4, "c0c1c2c3")]
