"""Near-duplicates by Jaccard similarity of word shingles: shards named by min-hashes, prefixes of shingles where those are crowded, and an exact check.

A text goes to one shard for each of TABLES independent min-hashes of its distinct shingles: texts of similarity s miss each other with probability (1 - s) ** TABLES (3 in 10,000 at 0.8). In a shard each text is compared with
all before it that its component does not hold already: first by sizes and by parities of SKETCH bits, whose differences are never more than those of the sets, so that nothing alike is passed over; then exactly, shingle set
against shingle set. A shard returns a spanning forest and not its pairs.

A min-hash that over HOT texts share (that of a passage common to many) is no shard. All texts that have one meet by prefixes instead, which is exact: in any one order of all shingles, sets of n shingles that are alike share one of
their first n - ceil(s * n) + 1. Common shingles come last in this order, so a passage alone makes no candidates; shingles of the same texts are one shard. A shingle that is in over HOT prefixes all the same is dealt out as
pairs of blocks of its texts, so no task holds them all and no pair is lost.
Shingles are compared by hashes of 32 bits. What is missed is what differs in all min-hashes: measured recall is in the README.

Defined cases: a null text counts as empty; texts without words are like one another alone; a text of fewer words than a shingle is one shingle; texts of any length are read whole; repeated rows are linked;
an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import spread

from .common import map_arrow, written
from .components import connected_components

TABLES, HOT, SKETCH = 5, 4_000, 1024
#: Bytes of sets in a batch of a text's copies for its shards.
_COPIES = 8 << 20
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k, h = min(words, len(found)), xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def _mixed(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (hashes ^ seed) * _SEEDS[0]
    x ^= x >> np.uint64(32)
    x *= _SEEDS[3]
    return x ^ (x >> np.uint64(29))


def minima(hashes: np.ndarray) -> list[int]:
    """TABLES min-hashes of distinct shingles, signed; zeros without shingles."""
    return [int(_mixed(hashes, s).min().view(np.int64)) if len(hashes) else 0 for s in _SEEDS]


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    if not len(x):
        return True
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _parities(own: np.ndarray) -> np.ndarray:
    """For each of SKETCH classes of shingles, whether the set holds an odd number of it: two sets differ in as many shingles as these bits at least."""
    return np.packbits(np.bincount(own & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1).view(np.uint64)


def forest(rows: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links (row, row) of a shard's rows (row, shingles): each with the first of its component."""
    sizes = np.array([len(own) for _, own in rows])
    sketches = np.stack([_parities(own) for _, own in rows])
    first, part = np.arange(len(rows)), (1 - similarity) / (1 + similarity)
    for i in range(1, len(rows)):
        n, of = sizes[i], sizes[:i]
        near = np.flatnonzero((np.minimum(of, n) >= similarity * np.maximum(of, n) - 1e-6) & (first[:i] != first[i]))
        near = near[np.bitwise_count(sketches[near] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= part * (of[near] + n) + 1e-6]
        for j in near.tolist():
            a, b = first[i], first[j]
            if a != b and _alike(rows[i][1], rows[j][1], similarity):
                first[: i + 1][first[: i + 1] == max(a, b)] = min(a, b)
    return [(rows[i][0], rows[first[i]][0]) for i in range(len(rows)) if first[i] != i]


def _shards(sketches: DataFrame) -> DataFrame:
    """sketches (row, m: array of min-hashes) to (key, row, n): the shards of each row that hold others, and how many rows they hold."""
    keys = sketches.select("row", F.explode(F.array(*(F.xxhash64(F.lit(i), F.element_at("m", i + 1)) for i in range(TABLES)))).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(keys.join(counts, "key").select("key", "row", "n"), "shards")


def _by_prefixes(rows: DataFrame, crowded: DataFrame, words: int, similarity: float, hot: int) -> DataFrame:
    """(key, row): shards of the crowded rows in which all that are alike meet."""
    texts, step = rows.join(crowded, "row", "left_semi"), max(1, hot // 500)

    def every(batches):
        for b in batches:
            for x in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_buffer().to_pybytes(), words).view(np.int64))], ["element"])

    # Any order of the shingles is right; one text of `step` tells which of them are better last.
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0)
    last = map_arrow(some, every, "element long").groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") * step > hot).toArrow()
    elements, counts = (last.column(c).to_numpy() for c in ("element", "n"))
    order = np.argsort(elements)
    common = rows.sparkSession.sparkContext.broadcast((elements[order], counts[order]))  # one of `hot` shingles at most

    def prefixes(batches):
        values, ranks = common.value
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = shingles(x.as_buffer().to_pybytes(), words).view(np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    rank = np.where(values[at] == own, ranks[at], 0)
                n = len(own) - math.ceil(similarity * len(own) - 1e-6) + 1
                out = own[np.lexsort((own, rank))[:n]] if len(own) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), row, np.int64)), pa.array(out)], ["row", "element"])

    elements = written(map_arrow(texts, prefixes, "row long, element long"), "prefixes")
    # Shingles that stand in the same rows' prefixes are one shard.
    sets = elements.groupBy("element").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).where("n > 1")
    met = elements.join(sets.groupBy("n", "a", "b").agg(F.min("element").alias("element")), "element")
    few = met.where(F.col("n") <= hot).select(F.xxhash64(F.lit("prefix"), "element").alias("key"), "row")
    blocks = F.ceil(F.col("n") * 2 / hot).cast("int")
    many = met.where(F.col("n") > hot).select("row", "element", F.pmod(F.xxhash64("row", F.lit(2)), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).where("own <> other")
    return few.unionByName(many.select(F.xxhash64(F.lit("blocks"), "element", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "row"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, hot: int = HOT) -> DataFrame:
    """docs (row: a unique long, text) to (row, label) for every row: equal labels for a component of texts that are alike."""
    rows = docs.select("row", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def sketched(batches):
        for b in batches:
            found = [minima(shingles(x.as_buffer().to_pybytes(), words)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "m"])

    sketches = written(map_arrow(spread(rows), sketched, "row long, m array<long>"), "sketches")
    met = _shards(sketches)
    shards, crowded = met.where(F.col("n") <= hot).select("key", "row"), met.where(F.col("n") > hot).select("row")
    if not crowded.isEmpty():
        shards = shards.unionByName(_by_prefixes(rows, crowded.distinct(), words, similarity, hot))
    shards = shards.groupBy("row").agg(F.collect_set("key").alias("keys"))  # as many as a prefix has shingles, at most, and those of blocks

    def spelled(batches):
        for b in batches:
            for row, text, keys in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = shingles(text.as_buffer().to_pybytes(), words)
                raw = np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes()
                size = _COPIES // (len(raw) + 1) + 1
                for at in range(0, len(keys), size):
                    some = keys[at : at + size]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row] * len(some), pa.int64()), pa.array([raw] * len(some), pa.binary())], ["key", "row", "set"])

    def linked(batches):
        held, at = [], None

        def close():
            found = forest(held, similarity) if len(held) > 1 else []
            held.clear()
            if found:
                a, z = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

        for b in batches:
            for key, row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != at:
                    yield from close()
                    at = key
                held.append((row, np.frombuffer(raw.as_buffer(), np.uint32)))
        yield from close()

    dealt = map_arrow(rows.join(shards, "row"), spelled, "key long, row long, set binary").repartition("key").sortWithinPartitions("key", "row")
    links = map_arrow(dealt, linked, "a long, b long")
    # The contraction wants well-mixed nodes: a hash of the row.
    labels = connected_components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    return sketches.select("row", F.xxhash64("row").alias("node")).join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("label"))
