"""The order kept up by batches, running folds over ranges, and views by signed deltas."""

import random
from collections import Counter

import pytest

from loomgraph.operators import order, scan, topology
from loomgraph.operators.graph import CycleError
from loomgraph.plans.maintained import compose
from loomgraph.streaming import views
from pyspark.sql import functions as F

D = ["structural", "causal", "intentional", "temporal", "relational"]


def edges(spark, rows):
    return spark.createDataFrame(list(rows), "parent string, child string")


def acyclic(pairs):
    left = set(pairs)
    while left:
        held = {c for _, c in left}
        rest = {(p, c) for p, c in left if p in held}
        if rest == left:
            return False
        left = rest
    return True


def test_numbers_follow_the_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.random()) for _ in range(500)] + [(2, 0.5)] * 400
    df = spark.createDataFrame(rows, "a int, b double").withColumn("row", F.monotonically_increasing_id())
    got = sorted(order.numbered(df, ["a", F.desc("b"), "row"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(900))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert order.numbered(df.limit(0), ["a"], "n").collect() == []


@pytest.mark.parametrize("before", [False, True])
def test_running_maximum_over_chunks(spark, monkeypatch, before):
    monkeypatch.setattr(order, "CHUNK", 7)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.randrange(1000)])) for i in range(100)]
    got = sorted(order.running_max(spark.createDataFrame(rows, "i int, v int"), ["i"], "v", "m", before).collect())
    for r in got:
        seen = [v for _, v in rows[: r.i + (not before)] if v is not None]
        assert r.m == max(seen, default=None)


@pytest.mark.parametrize("seed", range(2))
def test_batches_keep_an_order_or_are_refused(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    rank = {n: i for i, n in enumerate(rnd.sample(names, 40))}
    pick = lambda k, bad=0: {(a, b) if (rank[a] < rank[b]) != (rnd.random() < bad) else (b, a) for a, b in (rnd.sample(names, 2) for _ in range(k))}
    held = pick(30)
    table, places = edges(spark, held), topology.placed(edges(spark, held))
    assert topology.disordered(table, places).isEmpty()
    for bad in (0, 0.15, 0):
        batch = pick(12, bad)
        if acyclic(held | batch):
            held |= batch
            table, places = topology.insert(table, places, edges(spark, batch))
            places = topology.stored(places, "places")
        else:
            with pytest.raises(CycleError):
                topology.insert(table, places, edges(spark, batch))
        assert {tuple(r) for r in table.collect()} == held
        assert topology.disordered(table, places).isEmpty()
        at = [r.place for r in places.collect()]
        assert len(at) == len(set(at)) == len({n for e in held for n in e})


def test_only_what_lies_between_is_dealt_anew(spark):
    """A chain of 12 and a backward edge near its end: the nodes before keep their places."""
    chain = [(f"a{i:02}", f"a{i + 1:02}") for i in range(12)]
    table = edges(spark, [*chain, ("a10", "x"), ("a10", "y")])
    old = {r.node: r.place for r in topology.placed(table).collect()}
    _, places = topology.insert(table, topology.placed(table), edges(spark, [("y", "x"), ("a11", "x")]))
    new = {r.node: r.place for r in places.collect()}
    assert all(new[f"a{i:02}"] == old[f"a{i:02}"] for i in range(11))
    assert new["y"] < new["x"] and new["a11"] < new["x"] and sorted(new.values()) == sorted(old.values())


@pytest.mark.parametrize("bad", [[("d", "a")], [("c", "c")], [("b", "e"), ("e", "a")], [("f", "g"), ("g", "f")], [("d", "x"), ("x", "a")]])
def test_cycles_change_nothing(spark, bad):
    table = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")])
    places = topology.placed(table)
    before = sorted(map(tuple, places.collect()))
    with pytest.raises(CycleError):
        topology.insert(table, places, edges(spark, bad))
    assert sorted(map(tuple, places.collect())) == before


def test_repeated_and_empty_batches(spark):
    table = edges(spark, [("a", "b")])
    places = topology.placed(table)
    for batch in ([], [("a", "b")], [("a", "b"), ("a", "b")]):
        found, after = topology.insert(table, places, edges(spark, batch))
        assert found.count() == 1 and sorted(map(tuple, after.collect())) == [("a", 0), ("b", 1)]
    assert topology.placed(edges(spark, [])).collect() == []
    _, after = topology.insert(edges(spark, []), topology.placed(edges(spark, [])), edges(spark, [("b", "a"), ("c", "b")]))
    assert sorted((r.place, r.node) for r in after.collect()) == [(-1, "c"), (0, "b"), (1, "a")]


def folded(rows, fold, start):
    out, state = {}, {}
    for key, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        state[key] = fold(state.get(key, start), x)
        out[key, at] = state[key]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_fold_of_a_hot_key(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.choice(D + ["structural"] * 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, at int, x string")
    got = scan.running_fold(df, "key", ["at"], "x", D, compose, "relational", partitions=partitions)
    assert {(r.key, r.at): r.running for r in got.collect()} == folded(rows, compose, "relational")


def test_running_fold_of_another_operation(spark):
    """Rock, paper, scissors: who meets whom, the winner goes on. Neither associative nor with a neutral element."""
    beats = {("r", "s"), ("s", "p"), ("p", "r")}
    fold = lambda a, b: a if (a, b) in beats else b
    rnd = random.Random(5)
    rows = [(rnd.choice("kkkl"), i, rnd.choice("rps")) for i in range(700)]
    got = scan.running_fold(spark.createDataFrame(rows, "key string, at int, x string"), "key", ["at"], "x", "rps", fold, "r", partitions=6)
    assert {(r.key, r.at): r.running for r in got.collect()} == folded(rows, fold, "r")
    assert scan.running_fold(spark.createDataFrame([], "key string, at int, x string"), "key", ["at"], "x", "rps", fold, "r").collect() == []
    for bad in ("q", None):
        with pytest.raises(Exception, match="no state"):
            scan.running_fold(spark.createDataFrame([("k", 1, bad)], "key string, at int, x string"), "key", ["at"], "x", "rps", fold, "r").collect()


def sums(df):
    return {r.entry: tuple(r)[1:] for r in df.collect()}


def by_hand(rows):
    n, d = Counter(e for e, _ in rows), Counter(rows)
    return {e: (n[e], *(d[e, x] for x in D)) for e in n}


def changes(spark, rows, sign=1):
    return spark.createDataFrame([(e, x, sign) for e, x in rows], "entry string, dimension string, sign int")


def test_views_by_deltas(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.choice("abcd"), rnd.choice(D)) for _ in range(200)]
    view = views.View(spark, f"{tmp_path}/v")
    assert sums(view.sums()) == {} and view.served().isEmpty()
    assert view.apply(views.deltas(changes(spark, rows[:100]), "entry", "dimension"), 0)
    assert view.apply(views.deltas(changes(spark, [*rows[100:], (None, "causal"), ("a", "odd"), ("a", None)]), "entry", "dimension"), 1)
    assert not view.apply(views.deltas(changes(spark, rows), "entry", "dimension"), 1)  # a replay
    assert sums(view.sums()) == by_hand(rows)
    gone = [r for r in rows[:60] if r[0] in "ab"] + [r for r in rows if r[0] == "d"]
    left = list((Counter(rows) - Counter(gone)).elements())

    # Broken off after the fence, then after the deltas: withheld until it is repeated as a whole.
    view.fence("q", changes(spark, gone).select("entry"))
    assert set(sums(view.served())) == {"c"} and {r.entry for r in view.fenced().collect()} == {"a", "b", "d"}
    view.apply(views.deltas(changes(spark, gone), "entry", "dimension", F.lit(-1)), 2)
    assert set(sums(view.served())) == {"c"}
    view.erase("q", changes(spark, gone), "entry", "dimension", 2)
    assert sums(view.served()) == by_hand(left) and "d" not in sums(view.sums())
    assert views.identical(view.sums(), views.deltas(changes(spark, left), "entry", "dimension"))
    assert not views.identical(view.sums(), views.deltas(changes(spark, left[1:]), "entry", "dimension"))

    view.compact()
    view.compact()
    assert sums(view.sums()) == by_hand(left)
    assert not view.apply(views.deltas(changes(spark, rows), "entry", "dimension"), 1)  # compacted epochs stay taken
    assert view.apply(views.deltas(changes(spark, [("e", "causal")]), "entry", "dimension"), 3)
    assert sums(view.sums()) == by_hand([*left, ("e", "causal")])
    assert view.overdrawn().isEmpty()
    view.apply(views.deltas(changes(spark, [("e", "temporal")], -1), "entry", "dimension", F.col("sign")), 4)
    assert [r.entry for r in view.overdrawn().collect()] == ["e"]


def test_a_stream_of_changes_with_a_replayed_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice("abc"), rnd.choice(D)) for _ in range(90)]
    gone = rows[::10]
    for k in range(3):
        changes(spark, rows[k * 30 : k * 30 + 30]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    view = views.View(spark, f"{tmp_path}/v")
    follow, batches = view.follow(), []

    def kept(batch, epoch):
        batches.append((spark.createDataFrame(batch.collect(), batch.schema), epoch))
        follow(batch, epoch)

    def run():
        source = spark.readStream.schema("entry string, dimension string, sign int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = source.writeStream.foreachBatch(kept).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert len(batches) == 3 and sums(view.sums()) == by_hand(rows)
    follow(*batches[1])  # replayed
    assert sums(view.sums()) == by_hand(rows)
    changes(spark, gone, -1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # from the checkpoint
    assert [e for _, e in batches] == [0, 1, 2, 3]
    assert views.identical(view.sums(), views.deltas(changes(spark, list((Counter(rows) - Counter(gone)).elements())), "entry", "dimension"))
