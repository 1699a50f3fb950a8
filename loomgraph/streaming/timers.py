"""Anchored windows over a stream in the order of event time, by state and timers.

An event waits in its node's state until the watermark has passed it; then it is counted in the order of event times, whatever the order of arrival. So what comes out in the end is what operators.windows counts over a table of the same events, but for those that were behind the
watermark when they came, which count nowhere. A node has one timer, at the earliest of its waiting events and the end of its open window; when nothing waits and no window is open, its state is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomgraph.streaming.staleness import OUT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Flushes(StatefulProcessor):
    """span in milliseconds; event times are taken in milliseconds."""

    def __init__(self, span: int, threshold: int):
        self.span, self.threshold = span, threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")
        self.waiting = handle.getListState("waiting", "t long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(int(r.ts.timestamp() * 1000),) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(t for t, in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        times = sorted(t for t, in self.waiting.get()) if self.waiting.exists() else []
        due, later = [t for t in times if t <= now], [t for t in times if t > now]
        start, n = self.window.get() if self.window.exists() else (0, 0)
        out = []
        for t in due:
            if n and t - start > self.span:
                out.append((start, n, "gap"))
                n = 0
            start, n = (start, n + 1) if n else (t, 1)
            if n >= self.threshold:
                out.append((start, n, "burst"))
                n = 0
        if n and start + self.span < now:  # nothing that belongs to it can come any more
            out.append((start, n, "idle"))
            n = 0
        self._keep(start, n, later, now)
        for start, n, reason in out:
            yield Row(node=key[0], at=start, events=n, reason=reason)

    def _keep(self, start: int, n: int, later: list[int], now: int) -> None:
        if later:
            self.waiting.put([(t,) for t in later])
        elif self.waiting.exists():
            self.waiting.clear()
        if n:
            self.window.update((start, n))
        elif self.window.exists():
            self.window.clear()
        wake = [*later[:1], *([start + self.span + 1] if n else [])]
        if wake:
            self._wake(min(wake), now)

    def _wake(self, at: int, now: int = -1) -> None:
        """One timer a node, the earliest asked for; those up to now are going off."""
        ahead = [t for t in self.handle.listTimers() if t > now]
        if ahead and min(ahead) <= at:
            return
        for t in ahead:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def debounce_in_order(events: DataFrame, window_seconds: float, threshold: int, delay: str = "10 seconds") -> DataFrame:
    """events (node, ts) to one row per flush: node, at (first event of its window), events, reason (burst, gap, or idle once the watermark has passed its end). Event times count in milliseconds. The session's state store is set to RocksDB, which such state needs."""
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold!r}")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = events.select(F.col("node").cast("string").alias("node"), F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL").withWatermark("ts", delay)
    found = stream.groupBy("node").transformWithState(Flushes(round(window_seconds * 1000), threshold), "node string, at long, events long, reason string", "Append", "EventTime")
    return found.select("node", F.timestamp_millis("at").alias("at"), "events", "reason").to(_schema())


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(OUT)
