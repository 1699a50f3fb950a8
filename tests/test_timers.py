"""Anchored windows over a stream, out of order, restarted from a checkpoint, against the same events as a table."""

import datetime
import random

import pytest

from loomgraph.operators import windows
from loomgraph.streaming import timers

START = datetime.datetime(2026, 1, 1)


def test_a_stream_out_of_order_equals_the_table(spark, tmp_path):
    rnd = random.Random(3)
    times = sorted(rnd.randrange(3_000) for _ in range(160))
    rows = [(rnd.choice(["hot", "hot", "a", "b"]), START + datetime.timedelta(seconds=t)) for t in times]
    # Each file is shuffled inside and overlaps the one before by less than the delay.
    files = [rows[:60] + rows[70:80], rows[60:70] + rows[80:120], rows[120:], [("end", START + datetime.timedelta(days=1))], [("end", START + datetime.timedelta(days=2))], [("hot", START)]]

    def put(part):
        rnd.shuffle(part)
        spark.createDataFrame(part, "node string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema("node string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = timers.debounce_in_order(source, 60, 4, "500 seconds")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for k, part in enumerate(files):
        put(list(part))
        if k in (1, 4, 5):
            run()  # from the checkpoint of the run before
    got = spark.read.schema("node string, at timestamp, events long, reason string").parquet(f"{tmp_path}/out").where("node <> 'end'").collect()
    table = spark.createDataFrame(rows, "node string, ts timestamp").selectExpr("node", "cast(ts as double) as t")
    want = {r.node: r.flushes for r in windows.debounced(table, "node", "t", 60.0, 4).collect()}
    assert {n: sum(r.node == n for r in got) for n in want} == want
    assert sum(r.events for r in got) == len(rows)  # the last file's row was behind the watermark
    assert all(r.events == 4 for r in got if r.reason == "burst") and {r.reason for r in got} >= {"burst", "idle"}


def test_a_threshold_is_positive(spark):
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError, match="positive"):
            timers.debounce_in_order(spark.readStream.format("rate").load().selectExpr("'n' as node", "timestamp as ts"), 1, bad)
