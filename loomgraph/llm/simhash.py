"""SimHash near-duplicates by sharded BK-trees.

A fingerprint has 64 bits, each set where over half of a text's shingle hashes have it set. Two fingerprints within radius r that
are cut into m > r blocks agree in some m - r blocks, so each is sent to one shard for each choice of m - r blocks, named by
the bits of those blocks: pairs within the radius always meet. A shard holds distinct fingerprints that differ in r of m blocks only; one of over HOT
fingerprints is dealt on by the bits of those blocks, which are cut and chosen in the same way. In a shard a BK-tree is grown (children keyed by integer Hamming distance to the parent) and each fingerprint follows
only edges within the radius before it is inserted; a subtree known to lie in the component that the fingerprint has joined already is skipped, so that a
dense cluster does not cost its square. A shard returns a spanning forest of its links and not its pairs, and the forests
meet in a distributed contraction.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; rows with equal
fingerprints are always linked; rows whose doc_id is null take part but never name a component unless all its rows are null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import spread

from .common import map_arrow, written
from .components import connected_components

#: Odd multiplier that mixes fingerprints into node identifiers (a bijection on 64 bits).
MIX = 0x9E3779B97F4A7C15
#: Fingerprints in a shard, above which it is dealt on.
HOT = 200_000
_MASK = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Of a text in UTF-8: A-Z lower-cased, words between white space, shingles joined by one space, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k, h = min(shingle, len(words)), xxhash.xxh64_intdigest
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), node (the same, mixed) and the columns to carry for every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array((fps * np.uint64(MIX)).view(np.int64)), *b.columns[2:]], ["doc_id", "fp", "node", *carry])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *carry)
    return map_arrow(spread(rows), run, ", ".join(["doc_id long, fp long, node long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)]))


class BKTree:
    """Distinct integers below 2**64; add() links each with those within the radius and keeps components."""

    def __init__(self, radius: int):
        self.radius, self.values, self.below, self.whole, self.parent = radius, [], [], [], []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def within(self, x: int) -> list[int]:
        """Indexes of all values within the radius, nothing skipped."""
        found, stack = [], [0] * bool(self.values)
        while stack:
            i = stack.pop()
            d = (self.values[i] ^ x).bit_count()
            if d <= self.radius:
                found.append(i)
            stack.extend(c for k, c in self.below[i].items() if abs(k - d) <= self.radius)
        return found

    def add(self, x: int) -> None:
        me, r, values, below, whole, find = len(self.values), self.radius, self.values, self.below, self.whole, self.find
        self.parent.append(me)
        root, stack = me, [0] * (me > 0)
        while stack:
            i = stack.pop()
            if root != me and whole[i] >= 0 and find(whole[i]) == root:
                continue  # all below is linked with x already
            d = (values[i] ^ x).bit_count()
            if d <= r:
                top = find(i)
                self.parent[find(root)] = top
                root = top
            for k, c in below[i].items():
                if -r <= k - d <= r:
                    stack.append(c)
        values.append(x)
        below.append({})
        whole.append(me)
        i = 0
        while i != me:
            if whole[i] >= 0 and find(whole[i]) != root:
                whole[i] = -1
            i = below[i].setdefault((values[i] ^ x).bit_count(), me)

    def insert(self, x: int) -> None:
        """A new value, without links."""
        me, values, below = len(self.values), self.values, self.below
        self.parent.append(me)
        values.append(x)
        below.append({})
        self.whole.append(-1)
        i = 0
        while i != me:
            i = below[i].setdefault((values[i] ^ x).bit_count(), me)


def forest(fps: np.ndarray, radius: int):
    """Spanning links (node, node) of one shard's distinct fingerprints: each member with its component's least node."""
    tree = BKTree(radius)
    for x in fps.tolist():
        tree.add(x)
    roots = np.array([tree.find(i) for i in range(len(fps))])
    nodes = (fps * np.uint64(MIX)).view(np.int64)
    order = np.lexsort((nodes, roots))
    first = np.concatenate(([True], roots[order][1:] != roots[order][:-1]))
    least = nodes[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return nodes[order][~first], least[~first]


def masks(radius: int, blocks: int) -> list[int]:
    """Of each choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(free: int, radius: int) -> list[int]:
    """Masks over the bits of `free`, cut into radius + 3 blocks: each choice of three of them."""
    bits = [b for b in range(64) if free >> b & 1]
    m = radius + 3
    block = [sum(1 << b for b in bits[len(bits) * i // m : len(bits) * (i + 1) // m]) for i in range(m)]
    return [sum(c) for c in combinations(block, m - radius)]


def links(nodes: DataFrame, radius: int, blocks: int, hot: int = HOT) -> DataFrame:
    """nodes (fp, distinct) to spanning links (a, b) between nodes."""

    def run(batches):
        held = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64))
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def batch():
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def close(c, k, f):
            cut = np.concatenate(([0], np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1, [len(c)])) if len(c) else np.zeros(1, int)
            for i in np.flatnonzero(np.diff(cut) > 1).tolist():
                pair = forest(f[cut[i] : cut[i + 1]], radius)
                if len(pair[0]):
                    out.append(pair)

        for b in batches:
            new = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64))
            c, k, f = (np.concatenate(x) for x in zip(held, new, strict=True))
            same = np.flatnonzero((c != c[-1]) | (k != k[-1])) if len(c) else np.empty(0, int)
            last = int(same[-1]) + 1 if len(same) else 0
            close(c[:last], k[:last], f[:last])
            held = c[last:], k[last:], f[last:]
            if sum(len(x) for x, _ in out) > 50_000:
                yield batch()
        close(*held)
        if out:
            yield batch()

    first = masks(radius, blocks)
    shards = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(first))))
    dealt = nodes.select(shards.alias("s"), "fp").select("s.c", "s.k", "fp")
    # A crowded shard is dealt on by the bits that its name leaves open, in the same way: those within the radius agree in some of these blocks too.
    crowded = written(dealt.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("c", "k"), "crowded")
    if not crowded.isEmpty():
        inner = [_split(((1 << 64) - 1) ^ m, radius) for m in first]
        inside = dealt.join(crowded, ["c", "k"], "left_semi")
        names = F.array(*(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in of)) for of in inner))
        second = inside.select("c", "k", "fp", F.posexplode(F.element_at(names, F.col("c") + 1)).alias("i", "more"))
        second = second.select((F.lit(len(first)) + F.col("c") * 1000 + F.col("i")).alias("c"), F.xxhash64("k", "more").alias("k"), "fp")
        dealt = dealt.join(crowded, ["c", "k"], "left_anti").unionByName(second)
    return map_arrow(dealt.repartition("c", "k").sortWithinPartitions("c", "k", "fp"), run, "a long, b long")


def blocks_for(n: int, radius: int) -> int:
    """More distinct fingerprints need longer shard names: the fewest blocks whose shards hold 64 each on average, radius + 2 at least and radius + 4 at most."""
    m = radius + 2
    while m < radius + 4 and n >> (64 * (m - radius) // m) > 64:
        m += 1
    return m


def clusters(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Written prints (doc_id, fp, node) to fp, label (one for each component) and component_id for every distinct fingerprint."""
    nodes = written(prints.groupBy("fp", "node").agg(F.min("doc_id").alias("first")), "nodes")
    labels = connected_components(links(nodes.select("fp"), radius, blocks_for(nodes.count(), radius)))
    named = nodes.join(labels, "node", "left").select("fp", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(least, "label").select("fp", "label", "component_id")


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) for every row."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    return prints.select("doc_id", "fp").join(clusters(prints, radius).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
