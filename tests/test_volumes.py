"""What queries shuffle and store: rows, as Spark's own counters have them, on small tables that tell a step's growth."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import ranked_search
from loomgraph.operators import bitmaps, retrieval, topology
from loomgraph.operators.graph import CycleError
from loomgraph.plans import maintained
from loomgraph.sources import tables


def moved(spark, run) -> tuple[int, int]:
    """Rows shuffled, and rows stored, by all stages that run() starts."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()

    def ran():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.outputRecords()) for s in map(stages.apply, range(stages.size()))}

    before = ran()
    run()
    new = [v for k, v in ran().items() if k not in before]
    return sum(s for s, _ in new), sum(o for _, o in new)


@pytest.fixture
def many_tasks(spark):
    """Small tables in as many tasks as large ones."""
    made = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "4096"}
    before = {k: spark.conf.get(k) for k in made}
    for k, v in made.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_op11_pairs_of_query_and_near_copy_are_summed_where_they_arise(spark, many_tasks):
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join([*common, f"own{i}"])) for i in range(300)] + [(1_000 + i, " ".join(f"x{rnd.randrange(900)}" for _ in range(30))) for i in range(900)]
    items = [(i, " ".join(rnd.sample(common, 12))) for i in range(40)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    shuffled, _ = moved(spark, lambda: found.extend(ranked_search.search(*tables).collect()))
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in found) == [(i, k + 1, k) for i in range(40) for k in range(10)]
    assert shuffled < 60_000  # 12,000 pairs of up to twelve terms each; 138,974 rows when each term's range of postings sent its own sums


def test_op11_pairs_of_query_and_document_are_not_dealt_out_whatever_sizes_spark_sees(spark, many_tasks):
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join([*common, f"own{i}"])) for i in range(300)] + [(1_000 + i, f"x{i} y{i}") for i in range(900)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rnd.sample(common, 12))) for i in range(40)], "item_id long, text string")
    found, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where a table's many files look large
    try:
        shuffled, _ = moved(spark, lambda: found.extend(ranked_search.search(docs, items).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in found) == [(i, k + 1, k) for i in range(40) for k in range(10)]
    assert shuffled < 60_000  # 665,800 rows when postings went to the tasks of their terms, met the queries there and left as pairs


def test_terms_travel_by_chunk_and_not_by_document(spark, many_tasks):
    rnd = random.Random(6)
    common = [f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh"]
    docs = spark.createDataFrame([(i, " ".join([*rnd.sample(common, 50), "own" + chr(97 + i % 26)])) for i in range(400)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(399)], "a long, b long")
    for query in (lambda: retrieval.sparse_cosine(retrieval.bm25_vectors(docs), pairs), lambda: retrieval.term_claims(retrieval.bm25_vectors(docs))):
        shuffled, stored = moved(spark, lambda query=query: query().collect())
        assert shuffled < 6_000 and stored < 600  # 20,400 pairs of document and term, each stored and shuffled once or more before


def test_vectors_by_row_and_by_term_give_the_same(spark):
    rnd = random.Random(7)
    docs = [(rnd.randrange(20), " ".join(rnd.choice("Alpha beta THE gamma\u212a delta eps \u0131x shall zeta".split()) for _ in range(rnd.randrange(9)))) for _ in range(30)] + [(50, None), (51, "the of"), (None, "alpha beta")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows, vectors = retrieval.bm25(table), retrieval.bm25_vectors(table)
    plain = [(k, [t.lower() for t in re.findall("[a-zA-Z]{2,}", x or "")]) for k, x in docs]
    plain = [(k, [t for t in ts if t not in ("the", "of", "shall")]) for k, ts in plain]
    n, df = len(docs), Counter(t for _, ts in plain for t in set(ts))
    mean = round(sum(len(ts) for _, ts in plain) / n, 6)
    want = [(k, t, math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / mean))) for k, ts in plain for t, f in Counter(ts).items()]
    key = lambda x: (repr(x[0]), x[1], x[2])
    got = sorted(((r.doc_id, r.term, r.weight) for r in rows.collect()), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want, key=key)] and all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, sorted(want, key=key), strict=True))
    assert sorted(map(repr, retrieval.term_claims(rows).collect())) == sorted(map(repr, retrieval.term_claims(vectors).collect()))
    pairs = spark.createDataFrame([(a, b) for a in (*range(20), 50, None) for b in (0, 3, 50, 51, 99)] + [(1, 3), (1, 3)], "a long, b long")
    cosines = lambda v: Counter((r.a, r.b, r.cosine) for r in retrieval.sparse_cosine(v, pairs).collect())
    assert cosines(rows) == cosines(vectors) and cosines(rows).total() == pairs.count()
    sums, squares = defaultdict(lambda: defaultdict(float), {k: defaultdict(float) for k, _ in docs}), Counter()
    for k, t, w in got:
        sums[k][t] += w
        squares[k] += w * w
    for a, b, c in cosines(rows):
        norms = math.sqrt(squares[a] * squares[b]) if a is not None else 0
        assert abs(c - (sum(w * sums[b][t] for t, w in sums[a].items()) / norms if norms else 0)) < 2e-6


def test_candidates_are_stored_once_and_only_those_against_the_order_meet_the_search(spark, many_tasks):
    edges = spark.createDataFrame([("r", f"a{i}") for i in range(10)] + [(f"a{i % 10}", f"b{i}") for i in range(100)], "parent string, child string")
    places = topology.placed(edges)
    with_order = [(f"a{i}", f"b{j}", k) for i in range(10) for j in range(100) for k in range(3)]
    asked = [*with_order, ("b7", "a7", 0), ("b7", "a8", 0), ("b7", "a7", 1), ("b7", "r", 0), ("a1", "a1", 0), ("new", "r", 0), ("r", "new", 0), (None, "r", 0), (None, None, 0)]
    candidates, found = spark.createDataFrame(asked, "parent string, child string, k int"), []
    shuffled, stored = moved(spark, lambda: found.extend(topology.would_cycle(edges, places, candidates).collect()))
    cycles = {("b7", "a7", 0), ("b7", "a7", 1), ("b7", "r", 0), ("a1", "a1", 0)}
    assert Counter((r.parent, r.child, r.k, r.cycle) for r in found) == Counter((*x, x in cycles) for x in asked)
    assert shuffled < 600  # 1,139 rows when all candidates were made distinct and met what was found


def test_levels_of_a_deep_and_wide_graph(spark):
    deep = [(f"d{i}", f"d{i + 1}") for i in range(4)]
    wide = [("d4", f"w{i}") for i in range(40)] + [(f"w{i % 40}", f"x{i}") for i in range(300)] + [("d0", "x7"), ("d0", "y"), ("d0", "y")]
    edges = spark.createDataFrame([*deep, *wide], "parent string, child string")
    want = {f"d{i}": i for i in range(5)} | {f"w{i}": 5 for i in range(40)} | {f"x{i}": 6 for i in range(300)} | {"y": 1}
    assert sorted(map(tuple, topology.levels(edges).collect())) == sorted(want.items())
    with pytest.raises(CycleError):
        topology.levels(edges.union(spark.createDataFrame([("x7", "w7")], edges.schema)))


def test_edges_to_nodes_that_hold_nothing_are_stored_once_and_not_for_each_level(spark, many_tasks):
    deep = [(f"d{i}", f"d{i + 1}") for i in range(6)]
    edges = spark.createDataFrame([*deep, *((f"d{5 + i % 2}", f"x{i}") for i in range(400)), ("d0", "x1"), ("d6", "x2"), ("d6", "x2")], "parent string, child string")
    found = []
    _, stored = moved(spark, lambda: found.extend(topology.levels(edges).collect()))
    assert sorted(map(tuple, found)) == sorted([(f"d{i}", i) for i in range(7)] + [(f"x{i}", 7 if i % 2 or i == 2 else 6) for i in range(400)])
    assert stored < 700  # 3,243 rows when each level wrote all edges that were left
    assert topology.levels(edges.where("false")).collect() == []
    for parent, child in (("d6", "d2"), (None, "x1")):
        with pytest.raises(CycleError):
            topology.levels(edges.union(spark.createDataFrame([(parent, child)], edges.schema)))


def test_pairs_of_the_last_hop_are_not_stored(spark, many_tasks):
    links = spark.createDataFrame([(f"s{i}", f"m{i % 20}") for i in range(400)] + [(f"m{i}", f"t{j}") for i in range(20) for j in range(20)], "src string, dst string")
    found = {}
    _, stored = moved(spark, lambda: found.update(bitmaps.neighbourhoods(links, 2).collect()))
    assert found == {f"m{i}": 20 for i in range(20)} | {f"t{j}": 420 for j in range(20)}
    assert stored < 6_000  # 8,400 pairs of the second hop are counted as they come; 11,280 rows when they were stored


def test_names_that_are_small_in_files_alone_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    """The driver builds what is sent to all tasks; only numbers of ranges and maxima of chunks (`_range`, `_chunk`) and tables of one row may be, where everything counts as large."""
    monkeypatch.setattr(tables, "SENT", 0, raising=False)
    chosen, store = [], topology.stored
    sent = lambda df: re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())
    for module in (topology, maintained):
        monkeypatch.setattr(module, "stored", lambda df, what: chosen.extend((what, key) for key in sent(df)) or store(df, what))
    for name, columns in {
        "nation": "id AS n_nationkey, id % 5 AS n_regionkey", "customer": "id AS c_custkey, id % 25 AS c_nationkey", "orders": "id AS o_orderkey, id % 100 AS o_custkey",
        "supplier": "id AS s_suppkey, id % 25 AS s_nationkey", "part": "id AS p_partkey", "region": "id AS r_regionkey",
    }.items():
        spark.range({"nation": 25, "region": 5}.get(name, 100)).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = maintained.nesting_incremental_order(spark, str(tmp_path))
    chosen.extend(("result", key) for key in sent(found))
    assert [x for x in chosen if x[1] not in ("_range", "_chunk")] == []
    assert found.count() == found.select("place").distinct().count() == 431 and found.where("n_disordered <> 0").isEmpty()


def test_customers_of_a_small_file_are_not_sent_to_all_tasks(spark, tmp_path):
    """200,000 keys of a file of 0.8 MB: less than Spark would send by itself."""
    tables_of = {"customer": "id AS c_custkey", "supplier": "id AS s_suppkey, id % 25 AS s_nationkey", "part": "id AS p_partkey", "region": "id AS r_regionkey"}
    for name, columns in tables_of.items():
        spark.range(5 if name == "region" else 200_000).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = maintained._batch(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
