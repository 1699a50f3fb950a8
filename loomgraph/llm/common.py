"""What the corpus operators share: reading tables, Arrow batches, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch holds at most so many bytes, whatever the length of the texts.
BATCH_BYTES = 8 << 20
_WRITTEN: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it again, so that later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, but: int | None = None) -> None:
    """Deletes what written() has left since its since-th table, the last `but` ones excepted. For callers that have written their result elsewhere; tables still read must not go."""
    gone = _WRITTEN[since : len(_WRITTEN) - (but or 0)]
    del _WRITTEN[since : since + len(gone)]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def left() -> int:
    """Tables that written() has left and release() has not deleted."""
    return len(_WRITTEN)


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, since texts may be of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    arrow_limits(df.sparkSession)
    return df.mapInArrow(f, schema)


def ascii_lower(text):
    """A-Z only."""
    return F.translate(text, UPPER, LOWER)
