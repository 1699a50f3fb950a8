"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z. Each map task first inserts its texts into a compressed radix trie
of its own (bounded in memory; when full, its heaviest subtrees are spilled until it is half empty), so that a text held by a third of all rows leaves a task
once and not once per row. The surviving strings go to partitions by length and content hash, sorted by both: the top of the
final trie branches on (length, hash), and the strings of a stretch of that order are one subtree, a trie bounded in memory (labels and nodes), which is
read out and dropped when full, between two hashes, so that no copy of its strings comes later. What has yet to be inserted is
spilled by Spark's external sort in that same order. A terminal node stores the owner (smallest or largest identifier, as asked) and the count.
Decisions return to the rows by an equi-join on the SHA-256 of the normalised text, whose large partitions AQE can split.

Defined cases: a null text counts as empty, and empty texts are one class; a null doc_id never owns a class with other ids
(it sorts below every id when the largest is kept, above when the smallest is); repeated rows count each and share one owner, and the
row that stays is then each row with that id; further columns of the input are
kept, and those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import spread

from .common import ascii_lower, map_arrow

#: Memory of a trie, about, before it spills: bytes of labels and NODE_BYTES for each node.
TRIE_BYTES, NODE_BYTES = 48 << 20, 450
RESULTS = {"text_sha256", "keep_id", "group_size", "kept"}


class _Node:
    """label: bytes on the edge from the parent; below: children by first byte; here: (owner, count) of the string that ends here."""

    __slots__ = ("label", "below", "here")

    def __init__(self, label: bytes, here=None):
        self.label, self.below, self.here = label, None, here


class PatriciaTrie:
    """A compressed radix trie over byte strings whose terminals keep an owner and a count."""

    def __init__(self, keep: str = "min"):
        self.root, self.size, self.n = _Node(b""), 0, 0
        self.better = min if keep == "min" else max
        self.weights: dict[int, int] = {}  # memory of the subtree under each first byte

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        node, at, better = self.root, 0, self.better
        while True:
            if at == len(key):
                if node.here is None:
                    node.here, self.n = (owner, count), self.n + 1
                else:
                    o, c = node.here
                    node.here = (owner if o is None else o if owner is None else better(o, owner), c + count)
                return
            if node.below is None:
                node.below = {}
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = _Node(key[at:], (owner, count))
                self.n += 1
                self._grow(key[0], len(key) - at + NODE_BYTES)
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = len(commonprefix([child.label, key[at : at + len(child.label)]]))
            self._grow(key[0], NODE_BYTES)
            split = _Node(child.label[:shared])
            child.label = child.label[shared:]
            split.below = {child.label[0]: child}
            node.below[key[at]] = split
            node, at = split, at + shared

    def _grow(self, first: int, size: int) -> None:
        self.size += size
        self.weights[first] = self.weights.get(first, 0) + size

    def spill(self, down_to: int):
        """Gives out and drops the heaviest subtrees until no more than so much memory is left; the others go on collecting."""
        while self.size > down_to and self.weights:
            first = max(self.weights, key=self.weights.get)
            self.size -= self.weights.pop(first)
            gone = self.root.below.pop(first)
            for x in self.items(gone):
                self.n -= 1
                yield x

    def items(self, top: _Node | None = None):
        """(key, owner, count) of every terminal, or of those of a subtree of the root, depth first without recursion."""
        stack = [(top or self.root, b"")]
        while stack:
            node, above = stack.pop()
            key = above + node.label
            if node.here is not None:
                yield key, *node.here
            if node.below:
                stack.extend((x, key) for x in node.below.values())


def _rows(found) -> pa.RecordBatch:
    keys, owners, counts = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([len(k) for k in keys], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string()), pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64())],
        ["n_bytes", "sha", "key", "owner", "n"],
    )


def _cut(items, size: int = 8 << 20):
    part, held = [], 0
    for x in items:
        part.append(x)
        held += len(x[0]) + 64
        if held >= size:
            yield _rows(part)
            part, held = [], 0
    if part:
        yield _rows(part)


def tries(rows, keep: str = "min", limit: int = TRIE_BYTES):
    """rows (n_bytes, sha, key, owner, n) in order of n_bytes and sha to tries of many strings each: a full one is given out before the next (n_bytes, sha), when no copy of its strings is left to come."""
    at, trie = None, PatriciaTrie(keep)
    for n, sha, key, o, c in rows:
        if (n, sha) != at and trie.size > limit:
            yield trie
            trie = PatriciaTrie(keep)
        at = n, sha
        trie.insert(key, o, c)
    if trie.n:
        yield trie


def owners(docs: DataFrame, keep: str = "min", parts: int | None = None) -> DataFrame:
    """One row per distinct normalised text: sha (SHA-256, hex), n_bytes, owner, n."""

    def combine(batches):
        trie = PatriciaTrie(keep)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                trie.insert(text.as_buffer().to_pybytes(), i)
                if trie.size > TRIE_BYTES:
                    yield from _cut(trie.spill(TRIE_BYTES // 2))
        yield from _cut(trie.items())

    def decide(batches):
        out = []

        def batch():
            n, sha, o, c = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(o, pa.int64()), pa.array(c, pa.int64())], ["n_bytes", "sha", "owner", "n"])

        rows = (x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        for trie in tries(rows, keep):
            for key, o, c in trie.items():
                out.append((len(key), hashlib.sha256(key).hexdigest(), o, c))
                if len(out) > 10_000:
                    yield batch()
        if out:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long"), ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("key"))
    local = map_arrow(spread(rows), combine, "n_bytes long, sha string, key binary, owner long, n long")
    dealt = local.repartition(*[parts] * bool(parts), "n_bytes", "sha").sortWithinPartitions("n_bytes", "sha")
    return map_arrow(dealt, decide, "n_bytes long, sha string, owner long, n long")


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs with text_sha256, keep_id, group_size and kept for every row, dropped ones too."""
    by_text = owners(docs, keep).select(F.col("sha").alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    docs = docs.select(*(c for c in docs.columns if c.lower() not in RESULTS))
    keyed = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    return keyed.join(by_text, "text_sha256", "left").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
