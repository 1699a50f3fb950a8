"""Retrieval evaluation: citation signals, overlap weighted by rarity, an exact sign-flip test, and span scoring."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import numbered, running_sum
from loomgraph.sources.tables import stored

#: Differences that a sign-flip test enumerates at most: 2 to that power sums are counted, by meeting in the middle.
MOST_PAIRS = 40
#: Pairs of a sign-flip test over a table: the count of all sign choices fits 63 bits.
MOST_FLIPS = 62


def citation_signals(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges (src, dst), pairs (a, b) to (a, b, direct, cocitation, coupling): links between the two, sources that cite both, targets that both cite. Equi-joins from the pairs outward, so nothing but the neighbours of a pair
    meet; a frequent neighbour is split by AQE."""
    e = edges.select("src", "dst").distinct()

    def shared(end: str, other: str, name: str) -> DataFrame:
        left = pairs.join(e.select(F.col(end).alias("a"), F.col(other).alias("x")), "a")
        return left.join(e.select(F.col(end).alias("b"), F.col(other).alias("x")), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias(name))

    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    direct = pairs.join(both, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("direct"))
    found = pairs
    for signal in (direct, shared("dst", "src", "cocitation"), shared("src", "dst", "coupling")):
        found = found.join(signal, ["a", "b"], "left")
    return found.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "cocitation", "coupling")))


def two_hop_signatures(edges: DataFrame) -> DataFrame:
    """edges (src, dst, dimension) to (node, element): each typed link of a node, and each typed path of two links from it."""
    e = edges.select("src", "dst", "dimension").distinct()
    one = e.select(F.col("src").alias("node"), F.concat_ws("|", "dimension", "dst").alias("element"))
    x, y = e.alias("x"), e.alias("y")
    two = x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("node"), F.concat_ws("|", "x.dimension", "x.dst", "y.dimension", "y.dst").alias("element"))
    found = one.union(two)
    # Of different links the elements differ, unless a part is missing or holds the sign between parts.
    odd = e.where(F.col("dimension").isNull() | F.col("dst").isNull() | F.contains(F.col("dimension").cast("string"), F.lit("|")) | F.contains(F.col("dst").cast("string"), F.lit("|")))
    return found if odd.isEmpty() else found.distinct()


def rarity_overlap(sets: DataFrame, pairs: DataFrame, key: str, element: str) -> DataFrame:
    """pairs (a, b) to (a, b, overlap): the elements that both have over those that either has, each by the inverse of how many sets have it, in millionths."""
    s = sets.select(F.col(key).alias("k"), F.col(element).alias("e")).distinct()
    weight = s.groupBy("e").agg(F.expr("cast(round(1000000000000D / count(*)) as bigint)").alias("w"))
    s = s.join(weight, "e")
    totals = s.groupBy("k").agg(F.sum("w").alias("t"))
    common = pairs.join(s.withColumnRenamed("k", "a"), "a").join(s.select(F.col("k").alias("b"), "e"), ["b", "e"]).groupBy("a", "b").agg(F.sum("w").alias("c"))
    rows = pairs.join(totals.select(F.col("k").alias("a"), F.col("t").alias("m")), "a", "left").join(totals.select(F.col("k").alias("b"), F.col("t").alias("n")), "b", "left").join(common, ["a", "b"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    union = z("m") + z("n") - z("c")
    return rows.select("a", "b", F.when(union > 0, F.expr("coalesce(c, 0) * 1000000 div (coalesce(m, 0) + coalesce(n, 0) - coalesce(c, 0))")).otherwise(0).cast("long").alias("overlap"))


def sign_flip(differences: list[int]) -> tuple[int, int]:
    """Exact one-sided permutation test of paired differences (integers, such as millionths): how many of the 2 ** n sign choices have a sum of at least the observed one, and 2 ** n.
    Sums are counted, not listed: equal ones are held once."""
    if len(differences) > MOST_PAIRS:
        raise ValueError(f"over {MOST_PAIRS} pairs")
    sums = Counter({0: 1})
    for d in differences:
        step: Counter = Counter()
        for s, c in sums.items():
            step[s + d] += c
            step[s - d] += c
        sums = step
    return sum(c for s, c in sums.items() if s >= sum(differences)), 2 ** len(differences)


def sign_flip_test(differences: DataFrame, value: str) -> DataFrame:
    """differences (value, an integer for each pair; null counts as 0) to one row: at_least and total, as sign_flip, for as many as MOST_FLIPS pairs. The pairs are halved; each half's sums are a table of 2 ** (n / 2) rows, counted by sum, and the sums of both
    halves meet along one order: a running sum over the counts of the one tells for each of the other how many complete it."""
    spark = differences.sparkSession
    rows = stored(numbered(differences.select(F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("d")), ["d"], "i"), "differences")
    n = rows.count()
    if n > MOST_FLIPS:
        raise ValueError(f"over {MOST_FLIPS} pairs")
    halves = []
    for low, high in ((0, n // 2), (n // 2, n)):
        half = rows.where(F.col("i").between(low, high - 1)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("ds"))  # one row of n / 2 numbers
        total = F.aggregate("ds", F.struct(F.lit(0).cast("long").alias("sum"), F.col("id").alias("left")), lambda a, d: F.struct((a["sum"] + F.when(a["left"] % 2 == 1, -d).otherwise(d)).alias("sum"), F.shiftright(a["left"], 1).alias("left")), lambda a: a["sum"])
        sums = spark.range(1 << (high - low)).crossJoin(F.broadcast(half)).select(total.alias("sum"))
        halves.append(sums.groupBy("sum").agg(F.count("*").alias("n")))
    goal = rows.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("goal"))  # one row
    # From the largest sums down: those of the second half before what the first half still needs.
    need = halves[0].crossJoin(F.broadcast(goal)).select((F.col("goal") - F.col("sum")).alias("at"), F.lit(1).alias("asks"), F.col("n").alias("times"), F.lit(0).cast("long").alias("n"))
    have = halves[1].select(F.col("sum").alias("at"), F.lit(0).alias("asks"), F.lit(0).cast("long").alias("times"), "n")
    met = running_sum(need.union(have), [F.desc("at"), F.col("asks")], "n", "above").where("asks = 1")
    return met.agg(F.sum(F.col("times") * F.col("above")).cast("long").alias("at_least")).select("at_least", F.lit(1 << n).cast("long").alias("total"))


def span_matches(found: DataFrame, gold: DataFrame, unit: str) -> DataFrame:
    """found and gold (unit, start, end) to (unit, start, end, gold_start, gold_end): one-to-one matches of overlapping spans, the largest overlaps first, ties by place; equal spans are spans of their own.

    Overlaps are met by bins: a span lies in two bins at most of the width of its level (the power of two above its length), and of each higher level that there is; a pair is made in the bin of the longer one's level in which the overlap begins. Then each
    round takes the pairs that are the best of both their spans, which is what the whole order would take, until none is left: no unit is collected, and only what is left is read again."""
    sides = {}
    for name, spans in (("f", found), ("g", gold)):
        rows = spans.select(F.col(unit).alias("unit"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")).where("e > s AND unit IS NOT NULL")
        sides[name] = stored(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("level", F.ceil(F.log2((F.col("e") - F.col("s")).cast("double"))).cast("int")), "spans")
    top = max((x or 0 for side in sides.values() for x in side.agg(F.max("level")).first()), default=0)

    def binned(name: str) -> DataFrame:
        side = sides[name]
        at = side.withColumn("at", F.explode(F.sequence("level", F.lit(top))))
        bins = F.array_distinct(F.array(F.call_function("shiftright", F.col("s"), F.col("at")), F.call_function("shiftright", F.col("e") - 1, F.col("at"))))
        return at.withColumn("bin", F.explode(bins)).select("unit", "at", "bin", *(F.col(c).alias(f"{name}{c}") for c in ("s", "e", "id", "level")))

    pairs = binned("f").join(binned("g"), ["unit", "at", "bin"])
    pairs = pairs.where((F.col("at") == F.greatest("flevel", "glevel")) & (F.least("fe", "ge") > F.greatest("fs", "gs")) & (F.col("bin") == F.call_function("shiftright", F.greatest("fs", "gs"), F.col("at"))))
    rank = F.struct((F.greatest("fs", "gs") - F.least("fe", "ge")).alias("size"), "fs", "fe", "gs", "ge", "fid", "gid")
    left = stored(pairs.select("unit", "fs", "fe", "gs", "ge", "fid", "gid", rank.alias("rank")), "overlaps")
    taken = None
    while not left.isEmpty():
        best = [left.groupBy(c).agg(F.min("rank").alias(f"best_{c}")) for c in ("fid", "gid")]
        now = left.join(best[0], "fid").join(best[1], "gid").where("rank = best_fid AND rank = best_gid").select(*left.columns)
        now = stored(now, "matches")
        left = stored(left.join(now.select("fid"), "fid", "left_anti").join(now.select("gid"), "gid", "left_anti").select(*left.columns), "overlaps")
        taken = now if taken is None else taken.union(now)
    taken = left if taken is None else taken
    return taken.select(F.col("unit").alias(unit), F.col("fs").alias("start"), F.col("fe").alias("end"), F.col("gs").alias("gold_start"), F.col("ge").alias("gold_end"))


def span_scores(found: DataFrame, gold: DataFrame, unit: str) -> DataFrame:
    """found and gold (unit, start, end) to one row: matched, found, gold, and precision, recall and F1 in millionths."""
    counts = [x.agg(F.count("*").alias(name)) for x, name in ((span_matches(found, gold, unit), "matched"), (found, "found"), (gold, "gold"))]  # one row each
    total = counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))
    share = lambda x, y: F.when(y > 0, F.round(x * 1000000 / y).cast("long")).otherwise(0)
    m, f, g = F.col("matched"), F.col("found"), F.col("gold")
    return total.select("*", share(m, f).alias("precision"), share(m, g).alias("recall"), share(m * 2, f + g).alias("f1"))
