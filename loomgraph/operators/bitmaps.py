"""Neighbourhoods within some hops as sets of numbered nodes: sparse blocks as pairs, dense ones as bitmaps.

Nodes are numbered, and a set falls into blocks of 32,768 numbers. A block with few members is a row for each; one with many is a bitmap of 4 KiB, so that what a hub passes on to each of its neighbours are its blocks and not its members, and a union of them is an
OR. Both forms are exact, and a block changes its form by its number of members alone, where pairs would take more room than the bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import numbered
from loomgraph.sources.tables import stored

#: Members from which on a block is a bitmap: its 4 KiB over the 8 bytes of a member.
DENSE = 512


def _holds(bits: Column, number: Column) -> Column:
    """Whether a block's bitmap has the bit of a number."""
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1


def neighbourhoods(links: DataFrame, r: int, dense: int = DENSE) -> DataFrame:
    """links (src, dst) to (node, signal): how many different nodes lead to a node within r hops, itself excluded. Nodes that none leads to have no row."""
    if isinstance(r, bool) or not isinstance(r, int) or r < 0:
        raise ValueError(f"hops are 0 or more, got {r!r}")
    links = links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = stored(numbered(nodes, ["node"], "id").select("node", (F.col("id") + 1).alias("id")), "nodes")
    if r == 0:
        return nodes.select("node", F.lit(0).cast("long").alias("signal")).limit(0)
    by = lambda name, id_: nodes.select(F.col("node").alias(name), F.col("id").alias(id_))
    first = stored(links.join(by("src", "u"), "src").join(by("dst", "v"), "dst").select("v", "u").distinct(), "links")
    pairs, blocks = first.select("v", F.col("u").alias("x")), None
    if r > 1:
        pairs, blocks = _split(pairs, None, dense)
    for left in range(r - 2, -1, -1):
        more = first.join(pairs.select(F.col("v").alias("u"), "x"), "u").select("v", "x").union(pairs).distinct()
        ors = None if blocks is None else first.join(blocks.select(F.col("v").alias("u"), "block", "bits"), "u").select("v", "block", "bits").union(blocks)
        if not left and ors is None:  # nothing goes on from the last round: its pairs are counted as they come
            pairs = more
        else:
            pairs, blocks = _split(more, ors, dense)
    signal = pairs.where("x <> v").groupBy("v").agg(F.count("*").alias("n"))
    if blocks is not None:
        own = (F.bitmap_bucket_number("v") == F.col("block")) & _holds(F.col("bits"), F.col("v"))
        signal = signal.union(blocks.groupBy("v").agg(F.sum(F.bitmap_count("bits") - own.cast("long")).alias("n")))
    counts = signal.groupBy("v").agg(F.sum("n").alias("signal")).where("signal > 0")
    return counts.join(nodes, counts.v == nodes.id).select("node", "signal")


def _split(pairs: DataFrame, blocks: DataFrame | None, dense: int) -> tuple[DataFrame, DataFrame | None]:
    """pairs (v, x), each once, and blocks (v, block, bits) of the same sets, to the pairs of sparse blocks and the bitmaps of dense ones, each block in one of both; None for no bitmaps."""
    pairs = stored(pairs.withColumn("block", F.bitmap_bucket_number("x")), "pairs")
    full = pairs.groupBy("v", "block").agg(F.count("*").alias("n")).where(F.col("n") >= dense).select("v", "block")
    if blocks is not None:
        full = full.union(blocks.select("v", "block")).distinct()
    full = stored(full, "dense-blocks")
    if full.isEmpty():
        return pairs.select("v", "x"), None
    made = pairs.join(full, ["v", "block"], "left_semi").groupBy("v", "block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    every = made if blocks is None else made.union(blocks.select("v", "block", "bits")).groupBy("v", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return stored(pairs.join(full, ["v", "block"], "left_anti").select("v", "x"), "sparse-pairs"), stored(every, "blocks")
