"""Event streams: windows with watermarks, exactly-once changes, and state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 hour", lateness: str = "72 hours") -> DataFrame:
    """(window_start, keys, n): counts by event time; rows later than ``lateness`` behind the newest are dropped."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def distinct_changes(stream: DataFrame, at: str, keys: list[str], lateness: str = "72 hours") -> DataFrame:
    """Each change once, while its redelivery comes within ``lateness``; state older than that is let go."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness).dropDuplicatesWithinWatermark(keys).drop("_at")


def rate_windows(stream: DataFrame, at: str, key: str, seconds: int, limit: int, lateness: str = "1 hour") -> DataFrame:
    """(window_start, key, n, refused): requests per fixed window and how many were beyond the limit."""
    counts = windowed_counts(stream, at, [key], f"{seconds} seconds", lateness)
    return counts.withColumn("refused", F.greatest(F.lit(0), F.col("n") - limit))


def working_memory(stream: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, items, expired): items held per key; a key without a new item for ``ttl_seconds`` of event time expires.

    The state is one number a key, whatever the number of its items.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "items": [held], "expired": [True]})
            return
        held = state.get[0] if state.exists else 0
        last = None
        for part in parts:
            held += len(part)
            top = part["_at"].max()
            last = top if last is None or top > last else last
        state.update((held,))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_seconds * 1000)
        yield pd.DataFrame({key: [group[0]], "items": [held], "expired": [False]})

    timed = stream.select(key, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", f"{ttl_seconds} seconds")
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, items bigint, expired boolean", "held bigint", "update", GroupStateTimeout.EventTimeTimeout)
