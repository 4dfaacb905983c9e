"""Indexing jobs as a stream of events: what state each is in, and which are stuck."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources import snapshots

STATES = ("queued", "processing", "ready", "flagged", "error")
FINAL = STATES[2:]
LONGEST = 1000  # characters of an error
CHANGE = "job_id string, video_id long, status string, at timestamp, error string, ord long"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
STUCK = "no news"


def step(held: tuple | None, status: str, at: float) -> bool:
    """Whether an event moves a job that is ``held`` as (status, at): forward in the order of states, until it has ended for good."""
    return status in STATES and (held is None or (held[0] not in FINAL and STATES.index(status) > STATES.index(held[0])))


class Jobs(StatefulProcessor):
    """One row of state per open job. A job that has ended is remembered for ``forget`` seconds more, so events that come again change nothing; one without news for ``patience`` seconds ends in error."""

    def __init__(self, patience: float, forget: float, event_time: bool):
        self.patience, self.forget, self.event_time = patience, forget, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "video_id long, status string, at double, n long")

    def _wait(self, at: float, seconds: float, timers: TimerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        base = at * 1000 if self.event_time else timers.getCurrentProcessingTimeInMs()
        due = int(base + seconds * 1000)
        self.handle.registerTimer(max(due, timers.getCurrentWatermarkInMs() + 1) if self.event_time else due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        events = sorted(((r.at.timestamp(), STATES.index(r.status), r) for frame in rows for r in frame.itertuples(index=False) if r.status in STATES), key=lambda e: e[:2])
        out = []
        for at, _, r in events:
            if not step(held and held[1:3], r.status, at):
                continue
            n = held[3] + 1 if held else 0
            held = (int(r.video_id), r.status, at, n)
            out.append((key[0], held[0], r.status, r.at, (r.error or "")[:LONGEST] if r.status == "error" else None, n))
        if out:
            self.state.update(held)
            self._wait(held[2], self.forget if held[1] in FINAL else self.patience, timerValues)
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        video_id, status, at, n = tuple(self.state.get())
        if status in FINAL:
            self.state.clear()
            return
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self.state.update((video_id, "error", now, n + 1))
        self._wait(now, self.forget, timerValues)
        yield pd.DataFrame([(key[0], video_id, "error", pd.Timestamp(round(now * 1000), unit="ms").as_unit("us"), STUCK, n + 1)], columns=COLUMNS)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, patience: float = 3600.0, forget: float = 86400.0, late: str | None = "10 minutes") -> DataFrame:
    """(job_id, video_id, status, at, error, ord): each change of state of the jobs whose events (job_id, video_id, status, at, error) arrive; for the output mode "append".

    A job goes forward through queued, processing and one of ready, flagged, error; it may skip states, and events that are behind it, come again or have an unknown status or no time, job or video change
    nothing. ``late`` is the bound by which events may be late; a job is stuck if the events' time is ``patience`` seconds past its last change. With ``late`` None the clock on the wall
    counts instead. Needs the RocksDB state store.
    """
    rows = events.where("job_id is not null and video_id is not null and at is not null").select("job_id", "video_id", "status", "at", "error")
    if late is not None:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(Jobs(patience, forget, late is not None), CHANGE, "append", "processingTime" if late is None else "eventTime")


def keep_jobs(changes: DataFrame, path: str, checkpoint: str, then=None) -> StreamingQuery:
    """Keeps the last change of each job in the versioned table at ``path``; ``then(batch, number)`` gets the changes of a batch that end in ready, for re-indexing.

    A batch that is repeated after a failure writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("video_id", "job_id").agg(F.max_by(F.struct("status", "at", "error", "ord"), "ord").alias("c")).select("video_id", "job_id", "c.*")
        snapshots.upsert(latest, path, ["video_id", "job_id"], "ord", token=f"{checkpoint}:{number}")
        if then is not None:
            then(batch.where("status = 'ready'"), number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
