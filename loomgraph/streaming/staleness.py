"""Structured Streaming forms of staleness: coalesced propagation, and the window in which the last good view may be served."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "node string, at timestamp, events long, reason string"


def debounce_stream(events: DataFrame, window_seconds: float, threshold: int, delay: str = "10 seconds") -> DataFrame:
    """events (node, ts) to one row per propagation: node, at (first event of its window), events, reason (burst, gap or idle). A window is anchored at its first event; it is
    flushed at `threshold` events, by a gap, or once the watermark has passed its end. State is one window a node. Events of one micro-batch are sorted; one that is later than
    that but not behind the watermark counts when it arrives."""
    if threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold!r}")
    span = pd.Timedelta(seconds=window_seconds)

    def flushes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        start, n = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        if state.hasTimedOut:
            out.append((start, n, "idle"))
            n = 0
        else:
            for ts in sorted(t for batch in batches for t in batch["ts"]):
                if n and ts - start > span:
                    out.append((start, n, "gap"))
                    n = 0
                start, n = (start, n + 1) if n else (ts, 1)
                if n >= threshold:
                    out.append((start, n, "burst"))
                    n = 0
        if n:
            state.update((start.value // 1000, n))
            state.setTimeoutTimestamp(max(int((start + span).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["node", "at", "events", "reason"])

    stream = events.select(F.col("node").cast("string").alias("node"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return stream.groupBy("node").applyInPandasWithState(flushes, OUT, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_contributions(events: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """events (node, dim, ts) to counts by node, dimension and tumbling window; late rows beyond the delay are not counted, and state ends with its window."""
    stream = events.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "node", "dim").agg(F.count("*").alias("n"))
    return stream.select("node", "dim", F.col("w.start").alias("start"), "n")
