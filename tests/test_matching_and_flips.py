"""Span matching by rounds, the sign-flip test as a join, and cycle checks of many candidates, against plain versions."""

import random
from itertools import product

import pytest

from loomgraph.operators import evaluation as E
from loomgraph.operators import order, topology
from pyspark.sql import functions as F


def greedy(found, gold):
    out = []
    for u in {r[0] for r in found}:
        f, g = ([(a, z, i) for i, (w, a, z) in enumerate(side) if w == u and z > a] for side in (found, gold))
        pairs = sorted((max(x[0], y[0]) - min(x[1], y[1]), *x[:2], *y[:2], x[2], y[2]) for x in f for y in g if min(x[1], y[1]) > max(x[0], y[0]))
        left, right = set(), set()
        for _, a, z, b, y, i, j in pairs:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                out.append((u, a, z, b, y))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_the_greedy_ones(spark, seed):
    rnd = random.Random(seed)
    draw = lambda n: [(rnd.choice("abc"), s, s + rnd.choice([0, 1, 3, 8, 8, 40, 200])) for s in (rnd.randrange(300) for _ in range(n))]
    found, gold = draw(60), draw(50)
    found += found[:5]
    df = lambda rows: spark.createDataFrame(rows, "unit string, start int, end int")
    assert sorted(map(tuple, E.span_matches(df(found), df(gold), "unit").collect())) == greedy(found, gold)


def test_matches_of_one_large_unit(spark):
    """100,000 spans of one unit; each gold span lies in its own and reaches a little into the next."""
    ids = spark.range(100_000)
    found = ids.select(F.lit("u").alias("unit"), (F.col("id") * 20).alias("start"), (F.col("id") * 20 + 20).alias("end"))
    gold = ids.where("id % 3 > 0").select(F.lit("u").alias("unit"), (F.col("id") * 20 + 5).alias("start"), (F.col("id") * 20 + 24).alias("end"))
    (row,) = E.span_scores(found, gold, "unit").collect()
    assert (row.matched, row.found, row.gold, row.recall) == (66_666, 100_000, 66_666, 1_000_000)


def test_matches_of_nothing(spark):
    none = spark.createDataFrame([], "unit string, start int, end int")
    some = spark.createDataFrame([("u", 1, 4), (None, 1, 4)], "unit string, start int, end int")
    for a, b in ((none, none), (some, none), (none, some)):
        (row,) = E.span_scores(a, b, "unit").collect()
        assert row.matched == row.f1 == 0
    assert [tuple(r) for r in E.span_matches(some, some, "unit").collect()] == [("u", 1, 4, 1, 4)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 12])
def test_sign_flips_equal_enumeration(spark, n):
    rnd = random.Random(n)
    d = [rnd.randrange(-3, 4) * 100_000 for _ in range(n)]
    want = sum(sum(s * x for s, x in zip(signs, d, strict=True)) >= sum(d) for signs in product((1, -1), repeat=n))
    (row,) = E.sign_flip_test(spark.createDataFrame([(x,) for x in d], "d long"), "d").collect()
    assert (row.at_least, row.total) == (want, 2**n)


def test_sign_flips_of_many_pairs(spark):
    rnd = random.Random(1)
    d = [rnd.randrange(-50, 90) for _ in range(30)] + [0]
    (row,) = E.sign_flip_test(spark.createDataFrame([(x,) for x in d] + [(None,)], "d long"), "d").collect()
    assert (row.at_least, row.total) == E.sign_flip([*d, 0])
    with pytest.raises(ValueError, match="62"):
        E.sign_flip_test(spark.range(63), "id")


def test_running_sum_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 7)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.randrange(1000)])) for i in range(60)]
    for r in order.running_sum(spark.createDataFrame(rows, "i int, v int"), ["i"], "v", "s").collect():
        assert (r.s or 0) == sum(v or 0 for _, v in rows[: r.i + 1])


def test_cycles_of_many_candidates(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(30)]
    edges = [tuple(sorted(rnd.sample(range(30), 2))) for _ in range(45)]
    edges = [(names[a], names[b]) for a, b in edges]
    below = {n: {n} for n in names}
    for _ in range(30):
        for a, b in edges:
            below[a] |= below[b]
    candidates = [(a, b) for a in [*names[:15], "new"] for b in [*names, "other"]]
    df = lambda rows: spark.createDataFrame(rows, "parent string, child string")
    got = topology.would_cycle(df(edges), topology.placed(df(edges)), df(candidates)).collect()
    assert {(r.parent, r.child): r.cycle for r in got} == {(a, b): a == b or a in below.get(b, ()) for a, b in candidates}
    assert topology.would_cycle(df(edges), topology.placed(df(edges)), df([])).collect() == []


def test_two_hop_signatures_are_distinct_without_a_sort_of_all_paths(spark):
    from loomgraph.operators import evaluation as E

    plain = [("a", "b", "x"), ("a", "b", "x"), ("b", "c", "y"), ("b", "d", "x")]
    odd = [("a", "b", "x"), ("a", "b|y|c", "x"), ("b", "c", "y"), ("a", None, "x"), ("a", "x", None)]
    for rows in (plain, odd):
        found = E.two_hop_signatures(spark.createDataFrame(rows, "src string, dst string, dimension string"))
        got, e = [tuple(r) for r in found.collect()], set(rows)
        say = lambda *x: "|".join(v for v in x if v is not None)
        want = {(s, say(d, t)) for s, t, d in e} | {(s, say(d, t, d2, t2)) for s, t, d in e for s2, t2, d2 in e if t is not None and t == s2}
        assert set(got) == want and len(got) == len(want)
        assert ("Aggregate [node" in found._jdf.queryExecution().optimizedPlan().toString()) == (rows is odd)
