"""Suppress repeated questions while their stored answer is valid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 3600


def first_asked(
    stream: DataFrame, key: str, ts: str = "ts", ttl_seconds: int = TTL_SECONDS, lateness: str = "10 minutes"
) -> DataFrame:
    """``key, asked_at``: the requests that find no valid answer, and so store one.

    An answer is valid for less than ``ttl_seconds`` after the request that stored it; a
    request it serves does not renew it. Time is event time. A request waits in the state of
    its key until the watermark has passed it, then requests are settled in the order of
    their times, so the outcome does not depend on how they fall into micro-batches. The
    state of a key is the time of its stored answer and the requests that still wait; a
    timer settles them, and removes an answer that can serve no more. Rows later than
    the watermark are dropped; a null key passes nothing and only moves the watermark.
    """
    ttl = ttl_seconds * 1_000_000
    timed = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    timed = timed.withColumn("us", F.unix_micros("ts"))

    def settle(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, waiting = state.get if state.exists else (None, [])
        new = [] if state.hasTimedOut else [frame["us"] for frame in frames]
        if group[0] is None:
            return
        waiting = sorted({*waiting, *(int(t) for times in new for t in times.unique())})
        mark = state.getCurrentWatermarkMs() * 1000
        passed, done = [], 0
        for t in waiting:
            if t > mark:
                break
            done += 1
            if stored is None or t - stored >= ttl:
                passed.append(t)
                stored = t
        waiting = waiting[done:]
        due = waiting[0] if waiting else None if stored is None else stored + ttl
        if due is None or due <= mark:  # nothing waits, and whatever comes now finds the answer expired
            if state.exists:
                state.remove()
        else:
            state.update((stored, waiting))
            state.setTimeoutTimestamp(due // 1000 + 1)
        if passed:
            yield pd.DataFrame({"key": group[0], "asked_at": pd.to_datetime(passed, unit="us", utc=True)})

    return timed.groupBy("key").applyInPandasWithState(
        settle, "key string, asked_at timestamp", "stored long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
