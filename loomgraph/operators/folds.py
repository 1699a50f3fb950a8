"""Folds over the ordered rows of each group that hold one state and not the group: rows are dealt by group, sorted by Spark (on disk where need be) and read once, so a group of any size costs its length and no memory. For what is
sequential by nature: digests over sorted members."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import stored

#: Members of a group that are one array at most.
FEW = 4096


class Fold(Protocol):
    def add(self, *cells) -> None: ...

    def done(self) -> tuple: ...


def folded(rows: DataFrame, by: str, order: list[str], cells: list[str], new: Callable[[], Fold], results: list[T.StructField]) -> DataFrame:
    """One row for each group: by, and what done() gives after the cells of all its rows were added in order. A null group is a group."""
    key = rows.schema[by]
    schema = T.StructType([T.StructField(by, key.dataType), *results])
    picked = rows.select(by, *order, *(c for c in cells if c not in order))

    def run(batches):
        at, fold, out, key_type = None, None, [], None

        def batch():
            arrays = [pa.array([r[0] for r in out], key_type), *(pa.array([r[k + 1] for r in out]) for k in range(len(results)))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, [by, *(f.name for f in results)])

        for b in batches:
            key_type = b.schema.field(by).type
            for group, *values in zip(b.column(by).to_pylist(), *(b.column(c).to_pylist() for c in cells), strict=True):
                if fold is None or group != at:
                    if fold is not None:
                        out.append((at, *fold.done()))
                    at, fold = group, new()
                fold.add(*values)
                if len(out) > 10_000:
                    yield batch()
        if fold is not None:
            out.append((at, *fold.done()))
            yield batch()

    return picked.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


class _Digest:
    """SHA-256 over a canonical JSON object: lists of texts by name, in order of the names, and a tail."""

    def __init__(self, names: list[str], tail: str):
        self.names, self.tail, self.at, self.some, self.sha = names, tail, -1, False, hashlib.sha256(b"{")

    def _open(self, section: int) -> None:
        while self.at < section:
            if self.at >= 0:
                self.sha.update(b"],")
            self.at += 1
            self.some = False
            self.sha.update(f"{json.dumps(self.names[self.at])}:[".encode())

    def add(self, section: int, member: str) -> None:
        self._open(section)
        self.sha.update(((b"," if self.some else b"") + json.dumps(member).encode()))
        self.some = True

    def done(self) -> tuple:
        self._open(len(self.names) - 1)
        self.sha.update(f"],{self.tail}}}".encode())
        return (self.sha.hexdigest(),)


def digests(rows: DataFrame, by: str, names: list[str], tail: str, few: int = FEW) -> DataFrame:
    """rows (by, section: a place in names, member) to (by, digest): of {names[0]: [members, sorted], ..., tail} as canonical JSON, escaped as ASCII. A group of few members that need no escape is one array, and its text is built by expressions; SHA-256
    reads its text in order, so any other group is streamed, which is one task for as long as it takes (some 280,000 members a second, measured on 2 to 4 million of one group)."""
    rows = stored(rows.withColumn("section", F.col("section").cast("int")), "members")
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"), F.bool_and(F.col("member").rlike(r"^[ !#-\[\]-~]*$")).alias("_plain"))
    large = stored(sizes.where((F.col("_n") > few) | ~F.col("_plain")).select(F.col(by).alias("_by")), "large-groups")
    same = F.col(by).eqNullSafe(F.col("_by"))
    some = not large.isEmpty()
    lists = (rows.join(large, same, "left_anti") if some else rows).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("section", "member"))).alias("m"))
    part = lambda k: F.concat(F.lit(f"{json.dumps(names[k])}:["), F.array_join(F.transform(F.filter("m", lambda x: x["section"] == k), lambda x: F.concat(F.lit('"'), x["member"], F.lit('"'))), ","), F.lit("]"))
    found = lists.select(by, F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *map(part, range(len(names))), F.lit(tail)), F.lit("}")).cast("binary"), 256).alias("digest"))
    if some:
        streamed = folded(rows.join(large, same, "left_semi"), by, ["section", "member"], ["section", "member"], lambda: _Digest(names, tail), [T.StructField("digest", T.StringType())])
        found = found.unionByName(streamed)
    return found


def member_digests(members: DataFrame, by: str, member: str, version: int) -> DataFrame:
    """The digest of each container's set of members."""
    rows = members.select(by, F.lit(0).alias("section"), F.col(member).cast("string").alias("member")).distinct()
    return digests(rows, by, ["members"], f'"version":{version}')


def position_digests(claims: DataFrame, embeds: DataFrame, by: str, member: str, profile_digest: str) -> DataFrame:
    """The digest of each position: its claims and its embeds, repeats included, and the profile."""
    part = lambda df, k: df.select(by, F.lit(k).alias("section"), F.col(member).cast("string").alias("member"))
    return digests(part(claims, 0).unionByName(part(embeds, 1)), by, ["claims", "embeds"], f'"profile_digest":{json.dumps(profile_digest)}')
