"""Streams with true state: parts and events in any order, repeated or late, give what the batch gives.

Each key's state is a few named variables in the state store: a value for where it stands
and a map of what came too early; streamed answers, where they are many, share a key by
buckets.  Event-time timers end it, so a replay from the checkpoint ends the same keys at
the same rows; what arrives behind the watermark is left out by the engine, so nothing can
start a key again after it was forgotten.

Bounds: a key holds what came early and isn't yet due, at most as long as the timer waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators import iterative_cut
from parlance.streaming.jobs import MOVES

SEGMENTS = "array<struct<start_ms:long,end_ms:long,speaker:string,text:string>>"
PARTS = f"recording_id long, ts timestamp, part int, start_ms long, duration_ms long, total_ms long, segments {SEGMENTS}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("final", "final-empty")
#: How long, in event time, a recording may wait for its next part, and a finished key is remembered.
STALL_MS, KEEP_MS = 86_400_000, 3_600_000


def with_state_store(spark: SparkSession) -> None:
    """Named state variables need the store that keeps several column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _timed(rows: DataFrame, late: str, key: str):
    """Rows by key, with their time in milliseconds as ``at``."""
    return rows.withWatermark("ts", late).withColumn("at", F.unix_millis("ts")).groupBy(key)


class _Timed(StatefulProcessor):
    """One timer a key, moved on with the key's latest event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "latest long, timer long")

    def advance(self, latest: int, wait: int, timers) -> None:
        """The key's time is at least ``latest``; its timer goes off ``wait`` later."""
        before, timer = self.clock.get() or (0, 0)
        latest = max(before, latest, timers.getCurrentWatermarkInMs())
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + wait)
        self.clock.update((latest, latest + wait))

    def close(self) -> None:
        pass


class _Cuts(_Timed):
    """Where a recording is cut next, and the parts that came before their turn."""

    def __init__(self, stall_ms: int, keep_ms: int):
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.progress = handle.getValueState("progress", "cut long, due int, ended boolean")
        self.early = handle.getMapState("early", "part int", f"start_ms long, duration_ms long, total_ms long, segments {SEGMENTS}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cut, due, ended = self.progress.get() if self.progress.exists() else (0, 0, False)
        latest = 0
        for r in rows:
            latest = max(latest, r.at)
            if not ended and r.part >= due and not self.early.containsKey((r.part,)):
                self.early.updateValue((r.part,), (r.start_ms, r.duration_ms, r.total_ms, r.segments))
        while not ended and self.early.containsKey((due,)):
            start, duration, total, heard = self.early.getValue((due,))
            self.early.removeKey((due,))
            segments = [(s["start_ms"], s["end_ms"], s["speaker"], s["text"]) for s in heard or []]
            done = next(iterative_cut.plan(total, lambda a, b: segments, start + duration - cut, cut, due), None)  # noqa: B023
            if done is None:
                ended = True
                break
            ended = done["status"] in ENDED or done["end_cut_abs_ms"] <= cut or done["end_cut_abs_ms"] >= total - iterative_cut.DONE
            cut = done["end_cut_abs_ms"]
            yield Row(recording_id=key[0], part=due, status=done["status"], cut_ms=cut, next_start_ms=max(cut - iterative_cut.GUARD, 0))
            due += 1
        if ended:
            self.early.clear()
        self.progress.update((cut, due, ended))
        self.advance(latest, self.keep_ms if ended else self.stall_ms, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cut, due, ended = self.progress.get()
        for state in (self.progress, self.early, self.clock):
            state.clear()
        if not ended:
            yield Row(recording_id=key[0], part=due, status="stalled", cut_ms=cut, next_start_ms=max(cut - iterative_cut.GUARD, 0))


def cut_states(parts: DataFrame, late: str = "1 hour", stall_ms: int = STALL_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """The iterative cut as a stream: (recording_id, part, status, cut_ms, next_start_ms) of each part once all before it are there.

    ``parts`` (see ``PARTS``) is what a recogniser gives for a part.  Parts may come in any
    order and again.  A recording whose next part doesn't come for ``stall_ms`` gives a
    last row ``stalled``; a finished one is remembered for ``keep_ms``, to know repeats,
    and then leaves no state.  ``keep_ms`` should be no less than ``late``.
    """
    with_state_store(parts.sparkSession)
    return _timed(parts, late, "recording_id").transformWithState(_Cuts(stall_ms, keep_ms), "recording_id long, part int, status string, cut_ms long, next_start_ms long", "Append", "EventTime")


class _Jobs(_Timed):
    """A job's status, and the events whose time the watermark hasn't passed."""

    ORDER = {kind: i for i, kind in enumerate([*MOVES, "delete"])}

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, ts long, n_events long, result string")
        # one value, so that a key's events cost a call a batch and not several each
        self.early = handle.getValueState("early", "events array<struct<ts:long,turn:int,kind:string,n:int,detail:string>>")

    def waiting(self) -> dict:
        """What waits, by time and step: how often it came, and the first one's detail."""
        held = self.early.get()
        return {tuple(e)[:3]: tuple(e)[3:] for e in held[0]} if held else {}

    def settle(self, key, early: dict, before: bool, timers) -> Iterator[Row]:
        """Apply what lies before the watermark, in order of time and of the steps a job goes through, and set the next timer.

        It goes off at the first event that waits, or when a finished job is forgotten.  ``before`` tells whether the state has any that wait.
        """
        until = timers.getCurrentWatermarkInMs()
        status, last, n, result = self.job.get() or (None, 0, 0, None)
        due = sorted(k for k in early if k[0] < until)
        for at in due:
            times, detail = early.pop(at)
            for _ in range(times):
                n += 1
                allowed, to = ((status,), "deleted") if at[2] == "delete" else MOVES.get(at[2], ((), None))
                if status in allowed:
                    status, result = to, detail if to == "done" else None
            last = at[0]
        if early:
            self.early.update(([(*k, *v) for k, v in early.items()],))
        elif before:
            self.early.clear()
        if due:
            self.job.update((status, last, n, result))
        _, timer = self.clock.get() or (0, 0)
        at = min(k[0] for k in early) + 1 if early else last + self.ttl_ms if status in ("done", "error", "deleted") else 0
        at = at and max(at, until + 1)
        if timer != at:
            if timer:
                self.handle.deleteTimer(timer)
            if at:
                self.handle.registerTimer(at)
            self.clock.update((last, at))
        if due:
            yield Row(job_id=key[0], status=status, ts_ms=last, n_events=n, result=result)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        early = self.waiting()
        before = bool(early)
        for r in rows:
            at = (r.at, self.ORDER.get(r.kind, len(self.ORDER)), r.kind or "")
            n, detail = early.get(at, (0, r.detail))
            early[at] = (n + 1, detail)
        yield from self.settle(key, early, before, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if early := self.waiting():
            yield from self.settle(key, early, True, timerValues)
        else:
            for state in (self.job, self.early, self.clock):
                state.clear()


def job_states(events: DataFrame, ttl_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, ts, n_events, result) as events settle, whatever order they come in.

    An event counts once the watermark has passed it, so that none before it can still
    come.  ``delete`` ends a job in any status; a finish's detail is the job's result.  A
    job that is done, failed or deleted leaves no state ``ttl_ms`` after its last event.
    """
    with_state_store(events.sparkSession)
    rows = _timed(events, late, "job_id").transformWithState(_Jobs(ttl_ms), "job_id string, status string, ts_ms long, n_events long, result string", "Append", "EventTime")
    return rows.select("job_id", "status", F.timestamp_millis("ts_ms").alias("ts"), "n_events", "result")


def job_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every job that ``job_states`` knows, read from the state of the query that runs with this checkpoint (polling, fetching a result)."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    return state.select(F.col("key.job_id").alias("job_id"), "value.status", F.timestamp_millis("value.ts").alias("ts"), "value.n_events", "value.result")


PIECES = "stream_id string, ts timestamp, n int, piece string, last boolean"


class _Text(StatefulProcessor):
    """Texts that grow by numbered pieces, and the pieces that came before their turn.

    A key is a stream or a bucket of streams, whose state is one value, read and written whole: a
    batch costs a bucket a few state calls, and not each stream or piece several.  Rows without
    ``stream_id`` are the key's own.
    """

    def __init__(self, stall_ms: int, keep_ms: int):
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the streams as JSON, each [stream_id, latest, due, ended, text, [[n, piece, last], ...]]
        self.progress = handle.getValueState("progress", "timer long, streams string")

    def close(self) -> None:
        pass

    def read(self) -> tuple[int, dict]:
        """The timer that is set, or 0, and (latest, due, ended, text, early) of each stream."""
        timer, streams = self.progress.get() or (0, "[]")
        return timer, {stream: state for stream, *state in json.loads(streams)}

    def until(self, latest: int, ended: bool) -> int:
        """When a stream's wait ends, or a finished one is forgotten."""
        return latest + (self.keep_ms if ended else self.stall_ms)

    def write(self, streams: dict, timer: int) -> None:
        """Hold all streams, with one timer, for the first of them; ``timer`` is set."""
        if not streams:
            self.progress.clear()
            return
        at = min(self.until(latest, ended) for latest, _, ended, _, _ in streams.values())
        if at != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.progress.update((at, json.dumps([(stream, *state) for stream, state in streams.items()], ensure_ascii=False)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, streams = self.read()
        came, watermark = {}, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            came.setdefault(r.stream_id if "stream_id" in r else key[0], []).append((r.at, r.n, r.piece or "", bool(r.last)))
        for stream, new in came.items():
            latest, due, ended, text, early = streams.get(stream, (0, 0, False, "", ()))
            latest = max(latest, watermark, *(at for at, *_ in new))
            if not ended:
                # of two with one number, the first that came counts
                waiting = {n: (piece, last) for n, piece, last in early}
                for _, n, piece, last in new:
                    if n >= due:
                        waiting.setdefault(n, (piece, last))
                grown = [text]
                while not ended and due in waiting:
                    piece, ended = waiting.pop(due)
                    grown.append(piece)
                    due += 1
                text = "".join(grown)
                if ended:
                    yield Row(stream_id=stream, status="done", n_pieces=due, text=text)
                    text, waiting = "", {}
                early = [(n, *piece) for n, piece in waiting.items()]
            streams[stream] = (latest, due, ended, text, early)
        self.write(streams, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), {}
        for stream, state in self.read()[1].items():
            latest, due, ended, text, _ = state
            if self.until(latest, ended) > now:
                left[stream] = state
            elif not ended:
                yield Row(stream_id=stream, status="stalled", n_pieces=due, text=text)
        self.write(left, 0)


def token_texts(pieces: DataFrame, late: str = "10 minutes", stall_ms: int = STALL_MS, keep_ms: int = KEEP_MS, buckets: int | None = None) -> DataFrame:
    """(stream_id, status, n_pieces, text): a model's streamed answers, each once, when its last piece and all before it are there.

    Pieces (see ``PIECES``) are numbered from 0, the last is marked; they may come in any order
    and again.  What waits for a piece longer than ``stall_ms`` of event time gives what it has
    in a row, as ``stalled``.  Each stream has state of its own; with ``buckets``, where many are
    open at once, so many states hold them, and a task one of these at a time.  A checkpoint goes
    on only with the number it began with.
    """
    with_state_store(pieces.sparkSession)
    key = "stream_id" if buckets is None else "bucket"
    rows = pieces if buckets is None else pieces.withColumn(key, F.pmod(F.xxhash64("stream_id"), F.lit(buckets)))
    return _timed(rows, late, key).transformWithState(_Text(stall_ms, keep_ms), "stream_id string, status string, n_pieces int, text string", "Append", "EventTime")
