"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within each source by a seeded hash, ranked, and sorted by fractional rank (rank - 1/2) / rows of the source, so that
any run of the order holds every source in its share; the order is cut into shards whose row counts differ by one at most. No rank needs a
source, or the whole table, in one task: rows fall into buckets by the leading hexadecimal digits of their hash (and then by fractional rank), buckets are counted with
partial sums, the counts are accumulated over buckets, and rows are numbered inside their bucket alone. The number of buckets follows the number of rows.

Defined cases: a null text has no bytes, CRC-32 zero and size 16; a null source is a source; a null doc_id is hashed as the empty string, beside the text's CRC-32; texts of any length are read where they lie and never shuffled; repeated rows
take adjacent places; fewer rows than shards leave shards empty; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a bucket, about, up to MOST_BUCKETS (a source's counts by bucket are accumulated in one task); the result does not depend on either.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 1 << 20


def interleave(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    # The key is a hash of seed, doc_id and the text's CRC-32 (so rows without doc_id do not share one); its first eight digits as a number name the bucket.
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.crc32(text.cast("binary")).cast("string")).cast("binary"))
    rows = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = written(rows.withColumn("lead", F.conv(F.substring("key", 1, 8), 16, 10).cast("long")), "shuffled")
    total = rows.count()
    buckets = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("lead") * buckets / F.lit(float(1 << 32))).cast("int"))

    # Ranks within each source: rows in earlier buckets, then the place in the own one.
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("source")
    counts = counts.select("source", "bucket", (F.sum("n").over(by_source.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(by_source).alias("of"))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_crc32", "size"))
    near = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "of")
    ranked = rows.withColumn("place", place).join(near, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # Twice the rank less one, over twice the rows: a fraction of integers. Buckets by its floor, order by its double, then source.
    ranked = ranked.withColumn("twice", (F.col("before") + F.col("place")) * 2 - 1)
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "key", (F.col("twice") / (F.col("of") * 2)).alias("share"))
    ranked = written(ranked.withColumn("cell", F.least(F.floor(F.col("share") * buckets), F.lit(buckets - 1)).cast("int")), "ranked")

    # Places in the whole order, the same way over cells of the fraction.
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    block = cells.withColumn("block", F.floor(F.col("cell") / 1024))
    blocks = block.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("above"))
    cells = block.join(blocks, "block").select("cell", (F.col("above") + F.sum("n").over(Window.partitionBy("block").orderBy("cell")) - F.col("n")).alias("above"))
    order = Window.partitionBy("cell").orderBy("share", "source", "key", "doc_id", "text_crc32", "size")
    at = ranked.withColumn("place", F.row_number().over(order)).join(cells, "cell").withColumn("at", F.col("above") + F.col("place") - 1)
    # With q rows a shard and r shards of one more, the longer ones first.
    q, r = divmod(total, shards)
    long = r * (q + 1)
    shard = F.when(F.col("at") < long, F.floor(F.col("at") / (q + 1))).otherwise(r + F.floor((F.col("at") - long) / max(q, 1)))
    slot = F.when(F.col("at") < long, F.col("at") % (q + 1)).otherwise((F.col("at") - long) % max(q, 1))
    return at.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
