"""Rows numbered along one order of the whole table, without one task that reads it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.tables import stored


def numbered(df: DataFrame, order: list[Column | str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """df with its rows numbered from 0 along `order`: dealt by ranges of it, sorted within each, and written; a row's number is its place in its range, plus the rows of the ranges before. Rows that tie are numbered in any order; where very many
    tie, the order should end in a column that tells them apart, since equal rows lie in one range."""
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # The upper bits of the increasing id are the range, the lower 33 the place in it.
    rows = stored(ranges.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy(F.shiftrightunsigned("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # as many rows as ranges
    placed = rows.withColumn("_range", F.shiftrightunsigned("_at", 33)).join(F.broadcast(before), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


#: Rows of a chunk in a running maximum.
CHUNK = 4096


def running_max(df: DataFrame, order: list[Column | str], value: Column | str, name: str, before: bool = False) -> DataFrame:
    """df with the largest `value` of all rows up to each along `order` (before: without the row itself; null where there is none). Rows are numbered, a maximum runs inside each chunk of them, and one over the chunks' maxima: as many rows as chunks."""
    rows = numbered(df, order, "_n").withColumn("_v", value if isinstance(value, Column) else F.col(value)).withColumn("_chunk", F.floor(F.col("_n") / CHUNK))
    inside = Window.partitionBy("_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    chunks = rows.groupBy("_chunk").agg(F.max("_v").alias("_most"))
    chunks = chunks.select("_chunk", F.max("_most").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    found = rows.withColumn("_inside", F.max("_v").over(inside)).join(chunks, "_chunk")
    return found.select(*df.columns, F.greatest("_above", "_inside").alias(name))


def running_sum(df: DataFrame, order: list[Column | str], value: Column | str, name: str, kind: str = "decimal(38,0)") -> DataFrame:
    """df with the sum of `value` over all rows up to each along `order`, itself included: inside each chunk, and over the chunks' sums."""
    rows = numbered(df, order, "_n").withColumn("_v", (value if isinstance(value, Column) else F.col(value)).cast(kind)).withColumn("_chunk", F.floor(F.col("_n") / CHUNK))
    chunks = rows.groupBy("_chunk").agg(F.sum("_v").cast(kind).alias("_all"))
    chunks = chunks.select("_chunk", F.coalesce(F.sum("_all").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(kind).alias("_above"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("_inside", inside).join(chunks, "_chunk").select(*df.columns, (F.col("_above") + F.col("_inside")).cast(kind).alias(name))
