"""Neighbourhoods by bitmaps, path search by buckets and chains of windows, against plain versions, with hubs and hot keys."""

import heapq
import itertools
import math
import random
from collections import defaultdict

import pytest

from loomgraph.operators import bitmaps, paths, windows
from loomgraph.plans.maintained import compose
from pyspark.sql import functions as F

D = ["structural", "causal", "intentional", "temporal", "relational"]


def near(links, r):
    back = defaultdict(set)
    for s, d in links:
        back[d].add(s)
    out = {}
    for n in list(back):
        seen, front = set(), {n}
        for _ in range(r):
            front = set().union(*(back[x] for x in front)) - seen if front else set()
            seen |= front
        if seen - {n}:
            out[n] = len(seen - {n})
    return out


@pytest.mark.parametrize("dense", [1, 4, 512])
@pytest.mark.parametrize("r", [1, 2, 3])
def test_neighbourhoods_in_both_forms(spark, r, dense):
    rnd = random.Random(r * 10 + dense)
    links = [(f"n{min(rnd.randrange(60), rnd.randrange(60))}", f"n{rnd.randrange(60)}") for _ in range(150)]
    df = spark.createDataFrame([*links, *links[:9], (None, "n1"), ("n1", None)], "src string, dst string")
    assert {x.node: x.signal for x in bitmaps.neighbourhoods(df, r, dense).collect()} == near(links, r)


def test_neighbourhoods_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert bitmaps.neighbourhoods(none, 2).collect() == []
    some = spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string")
    assert bitmaps.neighbourhoods(some, 0).collect() == []
    assert [tuple(x) for x in bitmaps.neighbourhoods(some, 2).collect()] == [("b", 1)]
    for bad in (-1, True, 1.5):
        with pytest.raises(ValueError):
            bitmaps.neighbourhoods(some, bad)


def test_a_hub_of_many_neighbours(spark):
    """100,000 nodes lead to a hub that leads to 1,500: 150 million pairs, or 6,000 blocks."""
    into = spark.range(100_000).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("hub").alias("dst"))
    out = spark.range(1_500).select(F.lit("hub").alias("src"), F.concat(F.lit("b"), "id").alias("dst"))
    odd = spark.createDataFrame([("b1", "b0"), ("a5", "b0"), ("x", "b0"), ("b0", "hub")], "src string, dst string")
    got = {x.node: x.signal for x in bitmaps.neighbourhoods(into.union(out).union(odd), 2).collect()}
    assert got["hub"] == 100_001 + 2 + 0 and len(got) == 1_501  # a0.., b0; b1, x beyond b0 (a5 is there, the hub is itself)
    assert got["b7"] == 100_002 and got["b0"] == 100_003


def best(edges, start, floor):
    """Settled by weight, then hops."""
    out, queue, count = {}, [(-1.0, 0, 0, start, "relational")], itertools.count(1)
    while queue:
        w, h, _, node, dim = heapq.heappop(queue)
        if (node, dim) in out:
            continue
        out[node, dim] = (-w, h)
        for s, t, d, e in edges:
            if s == node and (floor is None or -w * e >= floor):
                heapq.heappush(queue, (w * e, h + 1, next(count), t, compose(dim, d)))
    return out


@pytest.mark.parametrize("floor, width", [(None, None), (0.1, 0.05), (0.0, 50.0)])
def test_paths_by_buckets(spark, floor, width):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", rnd.choice(D), rnd.choice([0.0, 0.25, 0.5, 0.5, 1.0, 0.125])) for _ in range(70)]
    df = spark.createDataFrame(edges, "source string, target string, dimension string, weight double")
    got = paths.typed_path_search(df, "n0", floor, width).collect()
    assert len(got) == len({(x.node, x.dimension) for x in got})
    assert {(x.node, x.dimension): (x.weight, x.hops) for x in got} == best(edges, "n0", floor)


def test_paths_refuse_what_they_must(spark):
    df = lambda w, d="causal": spark.createDataFrame([("a", "b", d, w)], "source string, target string, dimension string, weight double")
    for bad in (1.5, -0.1, math.nan, None):
        with pytest.raises(ValueError, match="within 0 and 1"):
            paths.typed_path_search(df(bad), "a")
    with pytest.raises(Exception, match="unknown dimension"):
        paths.typed_path_search(df(0.5, "odd"), "a").collect()
    with pytest.raises(ValueError, match="width"):
        paths.typed_path_search(df(0.5), "a", width=-1.0)
    assert [tuple(x) for x in paths.typed_path_search(df(0.5).limit(0), "q").collect()] == [("q", "relational", 1.0, 0)]


def flushed(times, window, threshold):
    out, start, n = 0, 0.0, 0
    for t in sorted(times):
        if n and t - start <= window:
            n += 1
        else:
            out += n > 0
            start, n = t, 1
        if n >= threshold:
            out, n = out + 1, 0
    return out + (n > 0)


@pytest.mark.parametrize("few", [0, 20, 4096])
@pytest.mark.parametrize("threshold", [1, 3, 7])
def test_windows_of_a_hot_key(spark, few, threshold):
    rnd = random.Random(threshold)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.choice([rnd.randrange(300) * 1.0, rnd.randrange(300) / 4, 7.0])) for _ in range(400)] + [("one", 5.0)]
    df = spark.createDataFrame([*rows, ("none", None)], "node string, at double")
    held = defaultdict(list)
    for k, t in rows:
        held[k].append(t)
    got = windows.debounced(df, "node", "at", 5.0, threshold, few)
    assert {x.node: x.flushes for x in got.collect()} == {k: flushed(t, 5.0, threshold) for k, t in held.items()}
