"""The job queue as streams: intake in order, states as events come, eviction, live counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id string, ts timestamp, kind string, detail string"
#: What each kind of event makes of a job, from the states in which it may come.
MOVES = {"upload": ((None,), "queued"), "start": (("queued",), "processing"), "finish": (("processing",), "done"), "fail": (("queued", "processing"), "error")}
TTL_MS = 600_000


def read_events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Event files as they come, oldest first, ``per_batch`` files at a time (one worker)."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(folder)


def state_changes(events: DataFrame, ttl_ms: int = TTL_MS, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, ts, n_events) after each batch that touched a job.

    A finished job's state is dropped ``ttl_ms`` of event time after its last event, so
    a replay drops the same jobs.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, n = state.get if state.exists else (None, 0)
        events = pd.concat(list(batches))
        # at one time, in the order in which a job goes through them
        events = events.assign(turn=events["kind"].map({k: i for i, k in enumerate(MOVES)}).fillna(len(MOVES))).sort_values(["ts", "turn"], kind="stable")
        for kind in events["kind"]:
            allowed, to = MOVES.get(kind, ((), None))
            if status in allowed:
                status = to
            n += 1
        state.update((status, n))
        if status in ("done", "error"):
            state.setTimeoutTimestamp(max(int(events["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "ts": [events["ts"].max()], "n_events": [n]})

    return events.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(
        step, "job_id string, status string, ts timestamp, n_events long", "status string, n long", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_queue(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every batch of uploads to ``work``; a restart goes on after the last finished batch."""
    return events.where("kind = 'upload'").writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()


def status_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by kind and window of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
