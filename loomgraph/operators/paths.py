"""Typed path search by buckets of distance: the best product of weights to each node and composed dimension.

A product of weights within 0 and 1 is a distance, -log weight, and distances are cut in buckets of a width. Only the lowest bucket that is open is joined with edges: with the light ones (shorter than the width) until nothing in it improves, and then, once, with the heavy
ones. No edge leads to a lower bucket, so what is in a closed one is settled and never written again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.sources.tables import stored

STATE = "node string, dimension string, weight double, hops int"
KEY = ["node", "dimension"]


def _best(states: DataFrame) -> DataFrame:
    """Of each node and dimension the highest weight, of these the least hops."""
    best = F.max(F.struct("weight", (-F.col("hops")).alias("back"))).alias("b")
    return states.groupBy(*KEY).agg(best).select(*KEY, F.col("b.weight").alias("weight"), (-F.col("b.back")).alias("hops"))


def typed_path_search(edges: DataFrame, start: str, floor: float | None = None, width: float | None = None) -> DataFrame:
    """edges (source, target, dimension, weight) to (node, dimension, weight, hops): the best product of weights for each node and composed dimension from start, with the least hops among equals; products below `floor` are cut. width: of a bucket, by default
    the mean length of an edge. A weight outside 0 and 1 is an error; zero is a weight, and the last bucket of all."""
    spark = edges.sparkSession
    length = F.when(F.col("weight") > 0, -F.log("weight"))
    bad, mean = edges.agg(F.count_if(F.col("weight").isNull() | ~F.col("weight").between(0, 1)), F.avg(F.when(F.col("weight") < 1, length))).first()
    if bad:
        raise ValueError("weights are within 0 and 1")
    width = width or mean or 1.0
    if not 0 < width < math.inf:
        raise ValueError(f"the width of a bucket is positive, got {width!r}")
    light, heavy = edges.where(length < width), edges.where((length >= width) | (F.col("weight") == 0))
    bucket = F.when(F.col("weight") > 0, F.floor(-F.log("weight") / width)).otherwise(F.lit(1 << 62)).cast("long")

    def relaxed(front: DataFrame, over: DataFrame) -> DataFrame:
        f, e = front.alias("f"), over.alias("e")
        step = f.join(e, F.col("f.node") == F.col("e.source")).select(
            F.col("e.target").alias("node"), A.compose(F.col("f.dimension"), A.dimension(F.col("e.dimension"))).alias("dimension"), (F.col("f.weight") * F.col("e.weight")).alias("weight"), (F.col("f.hops") + 1).alias("hops")
        )
        return _best(step if floor is None else step.where(F.col("weight") >= floor))

    settled, waiting = spark.createDataFrame([], STATE), spark.createDataFrame([(start, "relational", 1.0, 0)], STATE)
    while True:
        waiting = stored(_best(waiting.join(settled.select(*KEY), KEY, "left_anti")).withColumn("bucket", bucket), "waiting")
        lowest = waiting.agg(F.min("bucket")).first()[0]
        if lowest is None:
            return settled
        inside = front = stored(waiting.where(F.col("bucket") == lowest).select(*KEY, "weight", "hops"), "bucket")
        later = []
        while True:
            found = stored(relaxed(front, light).join(settled.select(*KEY), KEY, "left_anti").withColumn("bucket", bucket), "relaxed")
            later.append(found.where(F.col("bucket") > lowest).drop("bucket"))
            known = inside.select(*KEY, F.col("weight").alias("w"), F.col("hops").alias("h"))
            new = found.where(F.col("bucket") == lowest).join(known, KEY, "left").where("w IS NULL OR weight > w OR (weight = w AND hops < h)")
            front = stored(new.select(*KEY, "weight", "hops"), "bucket")
            if front.isEmpty():
                break
            inside = stored(_best(inside.union(front)), "bucket")
        settled = settled.union(inside)
        waiting = waiting.where(F.col("bucket") > lowest).select(*KEY, "weight", "hops").union(relaxed(inside, heavy))
        for states in later:
            waiting = waiting.union(states)
