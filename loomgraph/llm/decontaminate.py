"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The words of the benchmark's items (A-Z lower-cased; runs of digits, letters and non-ASCII characters) give windows of n words; an item of fewer
words, but not none, is one window. The windows go to all tasks as a hash set (sorted hashes, places and owners in arrays), in blocks whose size is counted and checked before any is
broadcast: a larger benchmark takes several scans, each writing what the next one reads, so one set is held at a time; a very long item is cut in pieces that share n - 1 words. A task numbers each document's words by the benchmark's vocabulary, hashes windows of known words
only, looks them up and verifies each hit against the words themselves. Whole documents are scanned; nothing is shuffled.

Defined cases: a null or empty text has no words and no hit; texts of any length are scanned whole; an empty documents table gives an empty one; items without words have no window; equal item_ids are one item; words of an item
without item_id are hit, but it is not listed; an empty benchmark leaves all documents clean; repeated rows each get their result; further
columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import spread

from .common import ascii_lower, map_arrow, written

#: Bytes that one broadcast set takes, about: 20 for each word, and WORD_BYTES and its text for each distinct one. Words of an item in one piece.
BLOCK_BYTES, WORD_BYTES, PIECE_WORDS = 192 << 20, 170, 50_000
RESULTS = {"n_words", "hits", "n_hit", "items", "contaminated"}
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WindowSet:
    """The windows of pieces of items (item, words, whether it is the first piece), by length: sorted hashes, where each window stands, and whose it is; all in arrays."""

    def __init__(self, pieces: list[tuple[str | None, list[str], bool]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _, _ in pieces]
        ids, owner, starts, at = [], [], {}, 0
        for k, (_, found, first) in enumerate(pieces):
            size = min(n, len(found))
            if size == 0 or size < n and not first:  # windows of a last piece this short lie in the one before
                continue
            ids.append(np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in found], np.uint64))
            owner.append(np.full(len(found), k, np.int32))
            starts.setdefault(size, []).append(np.arange(at, at + len(found) - size + 1))
            at += len(found)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int32)
        self.windows = {}
        for size, parts in starts.items():
            where = np.concatenate(parts)
            h = self._hash(np.lib.stride_tricks.sliding_window_view(self.ids, size)[where])
            order = np.argsort(h, kind="stable")
            self.windows[size] = h[order], where[order].astype(np.int32)
        self.ids = self.ids.astype(np.int32)

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j]) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set]:
        """A mask of hit words, and the items with occurring windows."""
        hit, items = np.zeros(len(found), bool), set()
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in found), np.uint64, len(found))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, (hashes, where) in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if len(starts) == 0:
                continue
            h = self._hash(np.lib.stride_tricks.sliding_window_view(ids, size)[starts])
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for i, a, z in zip(starts[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                own = ids[i : i + size].astype(np.int32)
                for at in where[a:z].tolist():  # the items that have this window
                    if np.array_equal(self.ids[at : at + size], own):
                        hit[i : i + size] = True
                        items.add(self.items[self.owner[at]])
        return hit, items


def pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id (as a string), part and w: the words of each item, in pieces that share n - 1 words, so that every window lies in one."""
    w = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), w.alias("w")).where("size(w) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE_WORDS)), lambda i: F.slice("w", i + 1, PIECE_WORDS + n - 1))
    return items.select("item_id", F.posexplode(cut).alias("part", "w")).dropDuplicates()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (ranges of hit words: start, end exclusive), n_hit, items (ids as strings, sorted) and contaminated."""
    spark = docs.sparkSession
    text_bytes = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    cut = pieces(benchmark, n).withColumn("cost", text_bytes + F.size("w") * (20 + WORD_BYTES)).withColumn("deal", F.xxhash64("item_id", "part", F.element_at("w", 1)))
    count, total = cut.agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0))).first()
    blocks = -(-total // block_bytes) or 1
    while 1 < blocks < 2 * count:  # the largest block is checked, and all are made smaller until it fits; a single piece is bounded anyway
        largest = cut.groupBy(F.pmod("deal", F.lit(blocks)).alias("b")).agg(F.sum("cost").alias("c")).agg(F.max("c")).first()[0]
        if largest <= block_bytes:
            break
        blocks *= 2
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = spread(docs.select(*own)).withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "items": F.expr("cast(array() as array<string>)")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    for k in range(blocks):
        block = cut.where(F.pmod("deal", F.lit(blocks)) == k) if blocks > 1 else cut
        shared = spark.sparkContext.broadcast(WindowSet([(r[0], r[1], r[2] == 0) for r in block.select("item_id", "w", "part").collect()], n))

        def run(batches, shared=shared):
            windows = shared.value
            for b in batches:
                at = {name: i for i, name in enumerate(b.schema.names)}
                counts, ranges, items = [], [], []
                for text, old, had in zip(b.column(at["text"]), b.column(at["hits"]).to_pylist(), b.column(at["items"]).to_pylist(), strict=True):
                    found = words(text.as_buffer().to_pybytes()) if text.is_valid else []
                    hit, new = windows.scan(found)
                    for x in old:
                        hit[x["start"] : x["end"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                    counts.append(len(found))
                    ranges.append([{"start": a, "end": z} for a, z in zip(edges[::2], edges[1::2], strict=True)])
                    items.append(sorted({*had, *(x for x in new if x is not None)}))
                new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(name, b.column(i)) for name, i in at.items()], list(at))

        rows = map_arrow(rows, run, schema)
        if k < blocks - 1:  # one set at a time: the next scan reads what this one has written
            rows = written(rows, "scanned")
            shared.unpersist()
    return rows.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words, and what stands between them, cut from the text."""
    # Own columns named like a result keep their values under another name meanwhile.
    aside = {c: f"own {i}" if c.lower() in RESULTS else c for i, c in enumerate(docs.columns)}
    found = decontaminate(docs.withColumnsRenamed(aside), benchmark, n)
    back = [F.col(f"`{b}`").alias(a) for a, b in aside.items()]
    if remove == "documents":
        return found.where(~F.col("contaminated")).select(*back)

    def run(batches):
        for b in batches:
            i = b.schema.names.index("text")
            texts = [cut_words(t, r) if r else t for t, r in zip(b.column(i).to_pylist(), b.column(b.schema.names.index("hits")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == i else b.column(k) for k, name in enumerate(b.schema.names) if name != "hits"], [x for x in b.schema.names if x != "hits"])

    return map_arrow(found.select(*aside.values(), "hits"), run, T.StructType([T.StructField(aside[f.name], f.dataType, True) for f in docs.schema])).select(*back)


def cut_words(text: str, ranges: list[dict]) -> str:
    """text without the bytes from the first to the last word of each range."""
    raw = text.encode()
    spaced, starts, ends = raw.translate(_TABLE), [], []
    at = 0
    for w in spaced.split():
        at = spaced.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for r in ranges:
        out.append(raw[last : starts[r["start"]]])
        last = ends[r["end"] - 1]
    return b"".join([*out, raw[last:]]).decode()
