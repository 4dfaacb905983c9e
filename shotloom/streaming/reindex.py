"""Structured Streaming: incremental re-indexing, daily usage, an event ledger, subscriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import snapshots
from ..sources.sinks import upsert


def usage_by_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Sums of prompt, completion and cost per user and day; rows later than ``late`` are left out, days then close."""
    days = stream.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "user_id")
    return days.agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cost_usd").alias("cost_usd")).select("user_id", F.col("w.start").alias("day"), "prompt", "completion", "cost_usd")


def reindex(stream: DataFrame, path: str, checkpoint: str, transform=lambda df: df, key=("video_id", "ord"), by: str = "video_id", versioned: bool = False) -> StreamingQuery:
    """Runs ``transform`` on what has arrived and puts it into the table at ``path`` by ``key``: the latest batch wins, all other rows stay.

    A video may arrive in several batches. A batch that is repeated after a failure writes the same rows again; into a ``versioned`` table (see ``snapshots``)
    it goes once, and readers see it whole or not at all.
    """

    def write(batch: DataFrame, number: int) -> None:
        if versioned:
            snapshots.upsert(transform(batch).withColumn("batch_no", F.lit(number).cast("long")), path, list(key), "batch_no", by, token=f"{checkpoint}:{number}")
            return
        upsert(transform(batch).withColumn("batch_no", F.lit(number).cast("long")), path, list(key), "batch_no", by)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_event(stream: DataFrame, late: str = "7 days", at: str = "received_at", key: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered within ``late``; a table that does not stream keeps one row per event for good."""
    if stream.isStreaming:
        return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return stream.groupBy(key).agg(F.min_by(F.struct(*(c for c in stream.columns if c != key)), at).alias("e")).select(key, "e.*")


def job_states(events: DataFrame) -> DataFrame:
    """The last status of each job (job_id, video_id, status, at): queued, processing, then ready, flagged or error; at one time the later of these counts."""
    rank = F.array_position(F.array(*map(F.lit, ("queued", "processing", "ready", "flagged", "error"))), F.col("status"))
    return events.groupBy("job_id", "video_id").agg(F.max_by("status", F.struct("at", rank)).alias("status"), F.max("at").alias("at"))


_STATE = "plan string, status string, customer string, period_end long, seen array<double>"
SUBSCRIPTIONS = "user_id long, plan_id string, status string, customer string, period_end long"


def subscriptions(stream: DataFrame) -> DataFrame:
    """The subscription of each user whose events (user_id, at, ord, type, status, customer, period_end) arrive, after them.

    Each field keeps the value of the latest event (by at and ord) that gives it one, in whatever order events arrive; for the output mode "update".
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, seen = (["free", "active", None, None], [float("-inf")] * 8) if not state.exists else (list(state.get[:4]), list(state.get[4]))
        for frame in frames:
            for e in frame.itertuples():
                new: list = [None] * 4
                if e.type == "checkout.session.completed":
                    new = ["developer", "active", e.customer or None, None]
                elif e.type in ("customer.subscription.created", "customer.subscription.updated"):
                    new = ["developer" if e.status in ("active", "trialing") else None, e.status or None, None, None if pd.isna(e.period_end) else int(e.period_end)]
                elif e.type == "customer.subscription.deleted":
                    new = ["free", "canceled", None, None]
                when = [float(pd.Timestamp(e.at).value) / 1e9, float(e.ord)]
                for i, v in enumerate(new):
                    if v is not None and when >= seen[2 * i : 2 * i + 2]:
                        values[i], seen[2 * i : 2 * i + 2] = v, when
        state.update((*values, seen))
        yield pd.DataFrame([(key[0], *values)], columns=["user_id", "plan_id", "status", "customer", "period_end"]).astype({"period_end": "Int64"})

    return stream.groupBy("user_id").applyInPandasWithState(fold, SUBSCRIPTIONS, _STATE, "update", GroupStateTimeout.NoTimeout)
