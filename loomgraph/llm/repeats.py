"""Removal of repeated byte strings by run-length Burrows-Wheeler indexes.

A byte goes if some string of N bytes that covers it also starts earlier (in a smaller document, or earlier in the same one). Equal strings must meet, without all
strings being shuffled: each string of N bytes is named by its anchor, the place of the least hash among its K-byte grams (the leftmost on ties), so
equal strings have equal anchors. The strings with one anchor are consecutive; together they are the anchor's context, of N to 2N - K bytes. Contexts are the unit of work:

1. A map over the documents finds contexts. Of equal contexts in a task only the first goes on; later ones are copies of it and removed there and then, as merged ranges.
2. By anchor: of equal contexts the first stays, later ones are removed whole. Different contexts of one anchor can share a string of N bytes only if they agree in SIDE bytes to the left of the
   anchor or in SIDE bytes to the right of it, since the N - K bytes around it lie at least half on one side. Contexts that agree with no other in either are done. The contexts of an anchor that has over
   HOT different ones are paired by these sides in a shuffle of their own, so no task holds them all.
3. The bytes of the contexts that agree with another on a side are fetched from the documents and come together by that side. For blocks of whole groups, in order of occurrence, the run-compressed BWT is
   built: run heads, run starts, the LF image of each run's start, and text positions sampled at the ends of runs and of classes (stretches of suffixes that share N bytes), of which
   the smallest is the class's first occurrence. The suffix array is dropped. The contexts are then streamed from right to left through the LF mapping of the runs, all in step, which gives
   for each place the stretch of the index that matches N bytes and so its earliest occurrence; places that are not their own earliest occurrence are marked. A side that over HOT_SIDE different contexts share would make too large an index: their strings are compared by hash instead, each by itself.
4. Marked ranges come together by document, are merged, and cut out.

Only hashes and places are shuffled for all of the text; bytes only for contexts that an index must tell apart, and once to cut. A common passage is reduced in each task
before it is shuffled. Contexts count as equal when 160 bits of hashes are (64 of all their bytes, 64 of the two sides, 32 of the anchor); bytes aren't compared for that.

Defined cases: a null text counts as empty; texts shorter than N lose nothing; texts of any length are read in pieces, so a task's memory does not grow with them but for the text itself; repeated rows (same doc_id and
text) are one document and get the same result; rows of one doc_id with different texts are ordered by a hash of the text; a null doc_id comes before all others (doc_ids are above -2**62), and rows without one are told apart by 126 bits of hashes; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.tables import spread

from .common import map_arrow, written

N, K = 100, 16
#: Bytes beside an anchor that two contexts must share on one side to share a string.
SIDE = (N - K + 1) // 2
#: Contexts that a map task holds before it passes them on, bytes that it hashes at once, bytes in one index, and different contexts of an anchor that one task compares.
HELD, PIECE, INDEX_BYTES, HOT = 400_000, 1 << 18, 64 << 10, 500_000
#: Contexts that share a side, above which they are not indexed but taken apart into strings.
HOT_SIDE = 10_000
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LAST = np.uint64(0xBF58476D1CE4E5B9)


def _fold(hashes: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    acc = start
    for h in hashes:
        acc = (acc ^ h) * _MULT[0]
        acc = acc ^ (acc >> np.uint64(29))
    return acc * _LAST


def _pieces(texts: list[bytes], size: int):
    """Lists of (text, start, bytes) of about `size` bytes; a long text is cut so that each string lies in one piece."""
    part, held = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - N + 1, size):
            piece = raw[at : at + size + N - 1] if len(raw) > size else raw
            part.append((i, at, piece))
            held += len(piece)
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def contexts(texts: list[bytes], piece: int = PIECE):
    """Batches of contexts: text (index), anchor, context (hash of its bytes), lr (hashes of the left and right side, 32 bits each, zero for one that is too short), start and number of strings;
    strings start at start, start + 1 and so on."""
    for part in _pieces(texts, piece):
        b = np.frombuffer(b"".join(x for _, _, x in part), np.uint8).astype(np.uint64)
        lengths = np.array([len(x) for _, _, x in part])
        offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        h, size = b + np.uint64(1), 1
        for m in _MULT:  # grams of 2, 4, 8 and 16 bytes
            h = h[:-size] * m + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        h *= _LAST
        h ^= h >> np.uint64(32)
        least, at, width = h, np.arange(len(h)), 1
        while width < N - K + 1:
            s = min(width, N - K + 1 - width)
            left = least[:-s] <= least[s:]
            at = np.where(left, at[:-s], at[s:])
            least = np.where(left, least[:-s], least[s:])
            width += s
        # Strings that lie in one text; a context ends where the anchor or the text changes.
        valid = np.zeros(len(at) + 1, np.int8)
        valid[offset] = 1
        last = offset + lengths - N + 1
        valid[last] -= 1
        inside = np.cumsum(valid[:-1]) > 0
        fresh = np.concatenate(([True], at[1:] != at[:-1]))
        fresh[offset] = True
        stop = np.concatenate((fresh[1:] | ~inside[1:], [True]))
        first, end = np.flatnonzero(fresh & inside), np.flatnonzero(stop & inside) + N
        anchor, n = at[first], end - first - N + 1
        digest = _fold([h[first]], n.astype(np.uint64))
        for k in range(1, -(-(2 * N) // K)):
            more = np.flatnonzero(first + K * (k - 1) < end - K)
            if not len(more):
                break
            digest[more] = _fold([h[np.minimum(first[more] + K * k, end[more] - K)]], digest[more])
        has_left, has_right = anchor - first >= SIDE, end - anchor >= SIDE + K
        a, z = np.where(has_left, anchor, SIDE), np.where(has_right, anchor, 0)
        left = _fold([h[a], h[a - SIDE], h[a - SIDE + K], h[a - K + 6]], np.full(len(a), 1, np.uint64)) >> np.uint64(32)
        right = _fold([h[z], h[np.minimum(z + K - 2, len(h) - 1)], h[np.minimum(z + 2 * K - 4, len(h) - 1)], h[np.minimum(z + SIDE, len(h) - 1)]], np.full(len(z), 2, np.uint64)) >> np.uint64(32)
        left, right = np.where(has_left, left | np.uint64(1), np.uint64(0)), np.where(has_right, right | np.uint64(1), np.uint64(0))
        which = np.searchsorted(offset, first, side="right") - 1
        text, base = np.array([i for i, _, _ in part]), np.array([x for _, x, _ in part])
        yield text[which], (h[anchor] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), digest.view(np.int64), ((left << np.uint64(32)) | right).view(np.int64), first - offset[which] + base[which], n


class RunIndex:
    """The run-compressed BWT of texts, each ended by a mark of its own, with the first occurrence of each class of N bytes."""

    def __init__(self, texts: list[bytes], n: int = N):
        m, lengths = len(texts), np.array([len(t) + 1 for t in texts])
        self.ends = np.cumsum(lengths) - 1
        symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + m
        symbols[self.ends] = np.arange(m)  # marks, in order, below all bytes
        total = len(symbols)
        # Suffixes are sorted by prefixes of 4 symbols, then of three (or, in a large index, two) times as many from their ranks, packed into one number.
        base, places = total + m + 256, np.arange(total)
        parts = 3 if base < 1 << 21 else 2
        rank, width, at_n, key = symbols, 1, None, None

        def packed(shifts):
            found = rank.copy()
            for x in shifts:
                found *= base
                found += rank[np.minimum(places + x, total - 1)]
            return found

        while True:
            if at_n is None and width <= n <= parts * width:
                at_n = packed([(n - width) // 2, n - width] if parts == 3 else [n - width])
            if width == 1 and (m + 256) < 1 << 15:
                key = ((symbols * (m + 256) + symbols[np.minimum(places + 1, total - 1)]) * (m + 256) + symbols[np.minimum(places + 2, total - 1)]) * (m + 256) + symbols[np.minimum(places + 3, total - 1)]
                width = 4
            else:
                key = packed([width * k for k in range(1, parts)])
                width *= parts
            order = np.argsort(key)
            sorted_key = key[order]
            step = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(total, np.int64)
            rank[order] = step
            if step[-1] == total - 1 or width > lengths.max():
                break
        if at_n is None:
            at_n = rank
        bwt = symbols[order - 1]  # of place 0: the last mark
        change = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.starts, self.heads = change, bwt[change]
        size = np.diff(np.concatenate((change, [total])))
        by_head = np.lexsort((change, self.heads))
        image = np.empty(len(change), np.int64)
        image[by_head] = np.concatenate(([0], np.cumsum(size[by_head])[:-1]))
        self.image = image
        # Classes: stretches of the order that share n bytes; the smallest sampled place of each.
        c = at_n[order]
        self.class_starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        self.first = np.minimum.reduceat(order, self.class_starts)
        self.rank_of_end = rank[self.ends]
        self.offset = np.concatenate(([0], self.ends[:-1] + 1))
        self.marks = m

    def stream(self, texts: list[bytes], n: int = N) -> list[np.ndarray]:
        """For each text of the index a mask of the places whose n bytes occur earlier in it."""
        lengths = np.array([len(t) for t in texts])
        marked = [np.zeros(max(0, len(t) - n + 1), bool) for t in texts]
        flat_at = np.concatenate(([0], np.cumsum([len(x) for x in marked])))
        flat = np.zeros(flat_at[-1], bool)
        who = np.argsort(-lengths, kind="stable")
        rows = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        j = self.rank_of_end[who]
        for step in range(1, int(lengths.max(initial=0)) + 1):
            alive = int(np.searchsorted(-lengths[who], -step, side="right"))
            who, j = who[:alive], j[:alive]
            run = np.searchsorted(self.starts, j, side="right") - 1
            at = lengths[who] - step
            if not np.array_equal(self.heads[run], rows[begin[who] + at] + self.marks):
                raise ValueError("the index doesn't spell the text")
            j = self.image[run] + j - self.starts[run]
            if step >= n:
                first = self.first[np.searchsorted(self.class_starts, j, side="right") - 1]
                flat[flat_at[who] + at] = first < self.offset[who] + at
        return [flat[a:b] for a, b in zip(flat_at, flat_at[1:], strict=False)]


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


_LOW = -(1 << 63)
CONTEXTS = "anchor int, context long, lr long, d long, h long, p long"
FOUND = "kind int, g long, lr long, d long, h long, s int, n int"
#: Kinds of found rows: a range that goes (n: its bytes), a context for an index (n: its strings), one of an anchor with over HOT contexts.
GONE, TELL, OPEN = 0, 1, 2


def _table(cols, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _context_rows(*cols):
    return _table(cols, ["anchor", "context", "lr", "d", "h", "p"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])


def _found_rows(*cols):
    return _table(cols, ["kind", "g", "lr", "d", "h", "s", "n"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _equal(x):
    return np.concatenate(([False], x[1:] == x[:-1]))


def _merged(d, h, a, z):
    """Ranges of bytes, overlapping or adjacent ones of a document joined. The ranges of one document must not lie in one another."""
    o = np.lexsort((a, h, d))
    d, h, a, z = d[o], h[o], a[o], z[o]
    joins = _equal(d) & _equal(h)
    joins[1:] &= a[1:] <= z[:-1]
    first = np.flatnonzero(~joins)
    return d[first], h[first], a[first], np.maximum.reduceat(z, first) if len(first) else z


def _sides(anchor, lr):
    """A name for the left and the right side of each context; zero where it is too short."""
    u, a = lr.view(np.uint64), anchor.astype(np.int64).view(np.uint64)
    names = []
    for k, side in enumerate((u >> np.uint64(32), u & np.uint64(0xFFFFFFFF))):
        names.append(np.where(side > 0, _fold([side], a * np.uint64(2) + np.uint64(k)) | np.uint64(1), np.uint64(0)).view(np.int64))
    return names


def _shared(x):
    """Which names, but for zero, are there more than once."""
    o = np.argsort(x, kind="stable")
    same = _equal(x[o])
    found = np.zeros(len(x), bool)
    found[o] = same | np.concatenate((same[1:], [False]))
    return found & (x != 0)


def find(docs: DataFrame, most: int = HELD, hot_from: int = HOT, piece: int = PIECE) -> DataFrame:
    """docs (d, h, t) to ranges that go and contexts for the indexes. Contexts without any like them are left out."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            anchor, context, lr, d, h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            o = np.lexsort((s, h, d, context))
            anchor, context, lr, d, h, s, n = (x[o] for x in (anchor, context, lr, d, h, s, n))
            later = _equal(context) & _equal(lr) & _equal(anchor)
            itself = later & _equal(d) & _equal(h) & _equal(s)  # a repeated row is no copy of itself
            later &= ~itself
            if later.any():
                gd, gh, a, z = _merged(d[later], h[later], s[later], (s + n + N - 1)[later])
                yield _context_rows((gd * 31 + a).astype(np.int32), a, z, gd, gh, np.full(len(a), -1))
            stays = ~later & ~itself
            anchor, context, lr, d, h, p = (x[stays] for x in (anchor, context, lr, d, h, s << 7 | n))
            for at in range(0, len(anchor), 100_000):
                yield _context_rows(*(x[at : at + 100_000] for x in (anchor, context, lr, d, h, p)))

        for b in batches:
            ds, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for which, anchor, context, lr, s, n in contexts([t.as_buffer().to_pybytes() for t in b.column(2)], piece):
                held.append((anchor, context, lr, ds[which], hs[which], s, n))
                if sum(len(x[0]) for x in held) >= most:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches):
        """Rows in order of anchor, context and occurrence: later ones go at once, the first of each context waits for the others of its anchor."""
        last, kept, count = None, [], 0

        def settle(cols):
            """The first of each context, whole anchors."""
            anchor, lr, d, h, p = cols
            left, right = _sides(anchor, lr)
            for name in (left, right):
                tell = _shared(name)
                if tell.any():
                    yield _found_rows(np.full(tell.sum(), TELL), name[tell], lr[tell], d[tell], h[tell], p[tell] >> 7, p[tell] & 127)

        def opened(cols):
            anchor, lr, d, h, p = cols
            return _found_rows(np.full(len(d), OPEN), anchor, lr, d, h, p >> 7, p & 127)

        hot = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            away = cols[5] < 0
            if away.any():
                a, z = cols[1][away], cols[2][away]
                yield _found_rows(np.full(len(a), GONE), np.zeros(len(a)), np.zeros(len(a)), cols[3][away], cols[4][away], a, z - a)
                cols = [c[~away] for c in cols]
            if not len(cols[0]):
                continue
            whole = cols if last is None else [np.concatenate((x, y)) for x, y in zip(last, cols, strict=True)]
            later = _equal(whole[0]) & _equal(whole[1]) & _equal(whole[2])
            itself = later & _equal(whole[3]) & _equal(whole[4]) & _equal(whole[5])
            gone = later & ~itself
            if gone.any():
                s, n = whole[5][gone] >> 7, whole[5][gone] & 127
                d, h, a, z = _merged(whole[3][gone], whole[4][gone], s, s + n + N - 1)
                yield _found_rows(np.full(len(a), GONE), np.zeros(len(a)), np.zeros(len(a)), d, h, a, z - a)
            first = ~later
            first[: 0 if last is None else 1] = False
            last = [c[-1:] for c in whole]
            new = [whole[i][first] for i in (0, 2, 3, 4, 5)]
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))  # rows of anchors that are complete
            if hot is not None and (ends := int(np.searchsorted(new[0], hot, side="right"))):
                yield opened([c[:ends] for c in new])
                new, cut = [c[ends:] for c in new], max(0, cut - ends)
                if not len(new[0]):
                    continue
            kept.append([c[:cut] for c in new])
            if cut:
                yield from settle([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept, count = [], 0
            kept.append([c[cut:] for c in new])
            count += len(kept[-1][0])
            if count > hot_from:
                held = [np.concatenate(x) for x in zip(*kept, strict=True)]
                begin = int(np.searchsorted(held[0], held[0][-1]))
                yield from settle([c[:begin] for c in held])
                yield opened([c[begin:] for c in held])
                kept, count, hot = [], 0, held[0][-1]
        if kept:
            yield from settle([np.concatenate(x) for x in zip(*kept, strict=True)])

    found = map_arrow(spread(docs.select("d", "h", F.col("t").cast("binary"))), run, CONTEXTS)
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "context", "lr", "d", "h", "p")
    return map_arrow(dealt, meet, FOUND)


def to_tell(found: DataFrame) -> DataFrame:
    """The contexts that go to the indexes, by the name of the side that they share (g): those of usual anchors are known, those of hot ones are counted by side."""
    left, right = F.shiftrightunsigned("lr", 32), F.col("lr").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("k"), left.alias("x")), F.struct(F.lit(1).alias("k"), right.alias("x"))))
    hot = found.where(F.col("kind") == OPEN).select(F.col("g").alias("anchor"), "d", "h", "s", "n", sides.alias("side")).where("side.x <> 0")
    hot = hot.select(F.xxhash64("anchor", "side.k", "side.x").alias("g"), "d", "h", "s", "n")
    many = hot.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    return found.where(F.col("kind") == TELL).select("g", "d", "h", "s", "n").unionByName(hot.join(many, "g", "left_semi"))


def later_strings(spelled: DataFrame) -> DataFrame:
    """The way of sides that very many contexts share. spelled (d, h, s, raw: the hash of a string of N bytes, 128 bits) to ranges (d, h, a, z): the first place of each string by partial minima, and every later place.
    The join's frequent strings are split by AQE, since each has one first place."""
    first = spelled.groupBy("raw").agg(F.min(F.struct("d", "h", "s")).alias("first"))
    return spelled.join(first, "raw").where(F.struct("d", "h", "s") > F.col("first")).select("d", "h", F.col("s").alias("a"), (F.col("s") + N).alias("z"))


def told_apart(spelled: DataFrame) -> DataFrame:
    """spelled (g, d, h, s, raw) to ranges (d, h, a, z) of bytes that go."""

    def run(batches):
        rows: list[tuple] = []
        held, group = 0, None

        def index():
            found = {r[:3]: r for r in rows}  # a context may be there under both of its sides
            rows[:] = [found[k] for k in sorted(found)]
            texts = [r[3] for r in rows]
            out = [(d, h, s + a, s + z - 1 + N) for (d, h, s, _), mask in zip(rows, RunIndex(texts).stream(texts), strict=True) for a, z in _ranges(mask)]
            rows.clear()
            if out:
                yield _table(list(zip(*out, strict=True)), ["d", "h", "a", "z"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

        for b in batches:
            for g, d, h, s, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if g != group and held >= INDEX_BYTES:
                    yield from index()
                    held = 0
                group = g
                rows.append((d, h, s, raw))
                held += len(raw)
        if rows:
            yield from index()

    dealt = spelled.select("g", "d", "h", "s", "raw").repartition("g").sortWithinPartitions("g", "d", "h", "s")
    return map_arrow(dealt, run, "d long, h long, a int, z int")


def spell(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted contexts (g, d, h, s, n, crowded), with one fetch of each document that has any; of crowded ones the hash of each string."""
    by_doc = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("g", "s", "n", "crowded")).alias("w"))

    def run(batches):
        for b in batches:
            for d, h, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                rows = [(x["g"], x["s"], raw[x["s"] : x["s"] + x["n"] + N - 1], False) for x in w if not x["crowded"]]
                for s in sorted({s for x in w if x["crowded"] for s in range(x["s"], x["s"] + x["n"])}):
                    rows.append((None, s, hashlib.blake2b(raw[s : s + N], digest_size=16).digest(), True))
                g, s, cut, crowded = zip(*rows, strict=True)
                yield _table([g, [d] * len(s), [h] * len(s), s, cut, crowded], ["g", "d", "h", "s", "raw", "crowded"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()])

    joined = docs.join(by_doc, ["d", "h"]).select("d", "h", F.col("t").cast("binary").alias("t"), "w")
    return map_arrow(joined, run, "g long, d long, h long, s int, raw binary, crowded boolean")


def remove_repeats(docs: DataFrame, most: int = HELD, hot_from: int = HOT, piece: int = PIECE, side_from: int = HOT_SIDE) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the maximal runs of bytes that go) and kept (the remaining bytes) for every row."""
    t = F.coalesce("text", F.lit(""))
    # A document is a doc_id and 64 bits of its text; without doc_id, 62 further bits stand in its place, below all doc_ids.
    none = F.lit(_LOW) + F.shiftrightunsigned(F.xxhash64(F.lit("none"), t), 2)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), none).alias("d"), F.xxhash64(t).alias("h"), t.alias("t"))
    found = written(find(keyed, most, hot_from, piece), "contexts")
    gone = found.where(F.col("kind") == GONE).select("d", "h", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("z"))
    tell, texts = to_tell(found), keyed.select("d", "h", "t")
    crowded = written(tell.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > side_from).select("g"), "crowded")
    if crowded.isEmpty():
        told = told_apart(spell(texts, tell.withColumn("crowded", F.lit(False))))
    else:
        marked = tell.join(crowded.withColumn("crowded", F.lit(True)), "g", "left").withColumn("crowded", F.col("crowded").isNotNull())
        spelled = written(spell(texts, marked), "spelled")
        told = told_apart(spelled.where(~F.col("crowded"))).unionByName(later_strings(spelled.where("crowded")))
    ranges = written(gone.unionByName(told).groupBy("d", "h").agg(F.collect_list(F.struct("a", "z")).alias("r")), "ranges")

    def cut(batches):
        for b in batches:
            n, spans, kept = [], [], []
            for text, r in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                n.append(len(raw))
                edge = np.zeros(len(raw) + 1, np.int32)
                if r:
                    np.add.at(edge, [x["a"] for x in r], 1)
                    np.add.at(edge, [x["z"] for x in r], -1)
                away = np.cumsum(edge)[:-1] > 0
                spans.append([{"start": a, "end": z} for a, z in _ranges(away)])
                kept.append(np.frombuffer(raw, np.uint8)[~away].tobytes() if r else raw)
            yield _table([b.column(0), n, spans, kept], ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()])

    whole = keyed.join(ranges, ["d", "h"], "left").select("doc_id", F.col("t").cast("binary").alias("t"), "r")
    return map_arrow(whole, cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
