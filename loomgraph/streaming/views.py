"""Materialised views by signed deltas, with a fence around erasures.

A view holds what each entry's statements add up to. Every batch of changes (+1 for a statement that comes, -1 for one that goes) is added up by entry and published once under its epoch: written aside, then renamed, so a batch that is replayed after a
failure finds its epoch taken and changes nothing. The view is the sum over its epochs; compact() folds them into one.

An erasure closes a fence over all entries that it touches before its deltas are published, and opens it after; what is behind a fence is not served. Sums of integers don't depend on order, so a view after an erasure equals, bit by bit, one that never held
the rows; identical() proves it for given tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A

D = A.DIMENSIONS


def deltas(changes: DataFrame, entry: str, dimension: str, sign: Column | None = None) -> DataFrame:
    """changes (entry, dimension, and a sign of 1 or -1) to one row an entry: entry, n and the five dimensions, added up before the shuffle. A row without entry or with an unknown dimension changes nothing."""
    s = (sign if sign is not None else F.lit(1)).cast("long")
    rows = changes.where(F.col(entry).isNotNull() & A.is_dimension(F.col(dimension))).select(F.col(entry).cast("string").alias("entry"), F.col(dimension).alias("_d"), s.alias("_s"))
    return rows.groupBy("entry").agg(F.sum("_s").alias("n"), *(F.sum(F.when(F.col("_d") == d, F.col("_s")).otherwise(0)).alias(d) for d in D))


class View:
    """A view under a folder that all executors share: epochs, fences (closed by an erasure) and lifted (those that are open again)."""

    SCHEMA = "entry string, n long, " + ", ".join(f"{d} long" for d in D)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, kind: str) -> list[str]:
        fs, path = self._at(kind)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _publish(self, rows: DataFrame, kind: str, name: str) -> bool:
        """Writes rows aside and gives them their name; False, and nothing has changed, if the name is taken."""
        fs, path = self._at(f"{kind}/{name}")
        if fs.exists(path):
            return False
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        fs.mkdirs(path.getParent())
        source = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
        if not fs.exists(path) and fs.rename(source, path):
            return True
        fs.delete(source, True)
        return False

    def apply(self, found: DataFrame, epoch: int) -> bool:
        """Publishes deltas as an epoch, once; False for one that was published before."""
        if epoch < 0:
            raise ValueError(f"epochs are 0 or more, got {epoch}")
        if self._done(epoch):
            return False
        return self._publish(found.where(" OR ".join(f"{c} <> 0" for c in ("n", *D))), "epochs", f"{epoch:012d}")

    def _done(self, epoch: int) -> bool:
        names = self._names("epochs")
        return f"{epoch:012d}" in names or any(n.startswith("to-") and int(n[3:]) >= epoch for n in names)

    def _live(self) -> list[str]:
        """The names that count: the latest compacted one, and the epochs behind it."""
        names = self._names("epochs")
        folded = max((n for n in names if n.startswith("to-")), default=None)
        behind = [n for n in names if not n.startswith("to-") and (folded is None or int(n) > int(folded[3:]))]
        return ([folded] if folded else []) + behind

    def sums(self) -> DataFrame:
        """entry, n and the dimensions, fences or not; entries that nothing is left of are gone."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.folder}/epochs/{n}" for n in live))
        return rows.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("n", *D))).where(" OR ".join(f"{c} <> 0" for c in ("n", *D)))

    def compact(self) -> None:
        """Folds the epochs so far into one, which is published as they were; they are deleted after it stands."""
        live = self._live()
        plain = [n for n in live if not n.startswith("to-")]
        if not plain or not self._publish(self.sums(), "epochs", f"to-{plain[-1]}"):
            return
        for name in live:
            fs, path = self._at(f"epochs/{name}")
            fs.delete(path, True)

    def overdrawn(self) -> DataFrame:
        """Entries of which more went than came: retractions of what the view never held."""
        return self.sums().where(" OR ".join(f"{c} < 0" for c in ("n", *D)))

    def fence(self, request: str, entries: DataFrame) -> bool:
        """Withholds entries (entry) until lift(request)."""
        return self._publish(entries.select(F.col("entry").cast("string").alias("entry")).where("entry IS NOT NULL").distinct(), "fences", request)

    def lift(self, request: str) -> bool:
        return self._publish(self.spark.range(1), "lifted", request)

    def fenced(self) -> DataFrame:
        """The entries (entry) behind a closed fence."""
        closed = sorted(set(self._names("fences")) - set(self._names("lifted")))
        if not closed:
            return self.spark.createDataFrame([], "entry string")
        return self.spark.read.schema("entry string").parquet(*(f"{self.folder}/fences/{n}" for n in closed)).distinct()

    def served(self) -> DataFrame:
        """What may be read now: sums() without the entries behind a fence."""
        return self.sums().join(self.fenced(), "entry", "left_anti")

    def erase(self, request: str, gone: DataFrame, entry: str, dimension: str, epoch: int) -> None:
        """Takes statements (entry, dimension) out of the view: fence, deltas, lift. Each step is published once, so an erasure that was broken off is repeated as a whole, and its entries stay withheld until then."""
        self.fence(request, gone.select(F.col(entry).alias("entry")))
        self.apply(deltas(gone, entry, dimension, F.lit(-1)), epoch)
        self.lift(request)

    def follow(self, entry: str = "entry", dimension: str = "dimension", sign: str = "sign") -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of changes: a micro-batch is an epoch."""
        return lambda batch, epoch: self.apply(deltas(batch, entry, dimension, F.col(sign)), epoch) and None


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, repeats counted, whatever their order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
