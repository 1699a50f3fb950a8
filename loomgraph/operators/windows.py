"""Windows that are anchored at their first event: how often each key is flushed.

A window takes events up to `window` seconds after its anchor, `threshold` at most; the next event is the next anchor. So each event, taken for an anchor, points to one later event, and a key's flushes are the length of the chain from its first one. Keys of few events are
folded as sorted arrays. For larger ones, all events are numbered along key and time, pointers come from one running maximum over events and ends of windows, and chains are measured by doubling the pointers: as many rounds as the logarithm of the longest
chain, each a join on the number, so a key of any size is spread over all tasks. Times are compared in whole microseconds, in both ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.operators.order import numbered, running_max
from loomgraph.sources.tables import stored

#: Events of a key that are folded as one array at most.
FEW = 4096


def debounced(events: DataFrame, by: str, seconds: str, window: float, threshold: int, few: int = FEW) -> DataFrame:
    """events (by, seconds) to (by, flushes): windows anchored at their first event, flushed at `threshold` events, by a gap or at the end. A null key is a key; events without a time are left out."""
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold!r}")
    span = round(window * 1e6)
    rows = events.select(F.col(by).alias("key"), F.round(F.col(seconds).cast("double") * 1e6).cast("long").alias("t")).where("t IS NOT NULL")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > few).select(F.col("key").alias("_key"))
    same = F.col("key").eqNullSafe(F.col("_key"))
    some = not large.isEmpty()
    small = rows.join(large, same, "left_anti") if some else rows
    flushes = A.debounce(F.collect_list(F.col("t").cast("double")), float(span), threshold)
    found = small.groupBy("key").agg(flushes.cast("long").alias("flushes"))
    if some:
        found = found.union(_chains(rows.join(large, same, "left_semi"), span, threshold))
    return found.withColumnRenamed("key", by)


def _chains(rows: DataFrame, span: int, threshold: int) -> DataFrame:
    """key and the length of the chain of anchors from its first event."""
    rows = stored(numbered(rows.withColumn("row", F.monotonically_increasing_id()), ["key", "t", "row"], "g").select("key", "t", "g"), "events")
    # Against the order of time, the last event before the end of a window is the first behind it; ends stand before events of the same time, which are still inside.
    marks = rows.select("key", "t", F.lit(1).alias("kind"), "g").union(rows.select("key", F.col("t") + span, F.lit(0), "g"))
    last = running_max(marks, [F.desc("key"), F.desc("t"), F.col("kind"), F.desc("g")], F.when(F.col("kind") == 1, -F.col("g")), "last")
    chain = last.where("kind = 0").select("key", "g", F.least(-F.col("last"), F.col("g") + threshold).alias("to"), F.lit(1).cast("long").alias("length"))
    chain = stored(chain, "chains")
    while not chain.where("to IS NOT NULL").isEmpty():
        on = chain.select(F.col("key").alias("_key"), F.col("g").alias("_g"), F.col("to").alias("_to"), F.col("length").alias("_length"))
        joined = chain.join(on, chain["to"] == F.col("_g"), "left")
        own = F.col("_g").isNotNull() & F.col("key").eqNullSafe(F.col("_key"))  # else the chain ends: the next event is another key's
        chain = stored(joined.select("key", "g", F.when(own, F.col("_to")).alias("to"), (F.col("length") + F.when(own, F.col("_length")).otherwise(0)).alias("length")), "chains")
    return chain.groupBy("key").agg(F.min_by("length", "g").alias("flushes"))
