"""The rate limit over a stream: the same window as in batch, kept per key between triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.guard import FixedWindow


def rate_limit_stream(events: DataFrame, key: str, at: str, event_id: str, most: int = 5, seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, at, accepted) of a stream of events.

    Events of one trigger are taken by time; one that is later than the watermark is dropped by the
    engine. A key's state goes when its window has run out.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null").withWatermark("at", late)

    def follow(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset_at = state.get if state.exists else (0, 0)
        window = FixedWindow(most, seconds * 1_000_000, count, reset_at)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        micros = rows["at"].astype("datetime64[us]").astype("int64")
        rows["accepted"] = [window.accept(int(us)) for us in micros]
        state.update((window.count, window.reset_at))
        state.setTimeoutTimestamp(max(window.reset_at // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[["key", "event_id", "at", "accepted"]]

    return rows.groupBy("key").applyInPandasWithState(follow, "key string, event_id long, at timestamp, accepted boolean", "count int, reset_at long", "append", GroupStateTimeout.EventTimeTimeout)
