"""Connected components by contraction, without collecting links anywhere.

In each round every node points to the smallest of itself and its neighbours, pointers are doubled once, links are renamed by
their ends' pointers, and loops and repeats go. Node identifiers must be well mixed (a hash, or a product by an odd constant), so that
a constant part of the nodes goes in each round whatever the shape of the graph. Minima combine before the shuffle and the joins are
plain equi-joins, so the centre of a large star is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, label): one row per node that has a link; label: the same for all nodes of a component.
    Loops and repeated links count for nothing; an empty table gives an empty one."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        up = least.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        points = written(least.join(up, "p").select("v", F.col("pp").alias("p")), "points")
        if labels is None:
            labels = points.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            labels = written(labels.join(points, labels.label == points.v, "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        ends = links.join(points, links.a == points.v).select(F.col("p").alias("a"), "b")
        ends = ends.join(points, ends.b == points.v).select("a", F.col("p").alias("b"))
        links = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
