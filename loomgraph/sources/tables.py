"""Tables of a folder, and inputs of fewer pieces than there are cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is a scan of fewer pieces than there are (one file of one row group, say), so that work in Python on it is parallel. A large table has more pieces and is left as it is; so is what has been shuffled."""
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt by a hash of columns to several tasks a core, and more where a task would get over 16 MB; tables of a few rows to one a core. For work in Python that takes long on each row: the pieces of a scan follow row groups, which
    may be few and uneven, and some hold nothing at all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, min(8 * cores, size >> 18), size >> 24), *by)


#: Bytes of files up to which a side of a join may be sent to all tasks. A row of names or keys takes a byte or a few there and some hundred where a broadcast is built, in the driver.
SENT = 512 << 10


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how), for sides that grow with the input: Spark would send one to all tasks by the size of its compressed files, which is a small part of what it takes in memory, so only what is small by SENT is left for that; all else is dealt out by the keys."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size(right) <= SENT or how == "inner" and size(left) <= SENT
    return left.join(right if small else right.hint("merge"), on, how)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it again: cuts its lineage, survives lost executors, and has sizes that joins can go by. Stays until the session's owner deletes it. Compressed by zstd, which takes less room than the default."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
