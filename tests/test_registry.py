import os

import duckdb
import pytest

from loomgraph.functions import algebra as A
from loomgraph.operators import graph as G
from loomgraph.plans import law, maintained, registry, rules, texts

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()

QUERIES, ORACLES = registry.QUERIES | texts.QUERIES | rules.QUERIES | maintained.QUERIES | law.QUERIES, registry.ORACLES | texts.ORACLES | rules.ORACLES | maintained.ORACLES | law.ORACLES


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    rel = oracle.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))


def test_cyclic_product_graph(spark):
    edges = spark.createDataFrame([("n0", "n2", "temporal", 0.5), ("n0", "n2", "temporal", 0.9), ("n2", "n2", "intentional", 0.5)], "source string, target string, dimension string, weight double")
    found = {(r.node, r.dimension, r.weight, r.hops) for r in G.typed_path_search(edges, "n0").collect()}
    assert found == {("n0", "relational", 1.0, 0), ("n2", "temporal", 0.9, 1), ("n2", "intentional", 0.45, 2)}


def test_debounce_window_is_anchored_at_its_first_event(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0, 100.0],), ([],), ([5.0],)], "t array<double>")
    assert [r[0] for r in df.select(A.debounce(df.t, 10.0, 5)).collect()] == [2, 0, 1]


def test_stale_diamond(spark):
    edges = spark.createDataFrame([("a", "leaf"), ("b", "leaf"), ("top", "a"), ("top", "b")], "parent string, child string")
    found = {(r.node, r.level) for r in G.stale_ancestors(edges, spark.createDataFrame([("leaf",)], "node string")).collect()}
    assert found == {("leaf", 0), ("a", 1), ("b", 1), ("top", 2)}
    round_ = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "leaf")], "parent string, child string")
    with pytest.raises(G.CycleError):
        G.stale_ancestors(round_, spark.createDataFrame([("leaf",)], "node string"))
    assert G.propagation_order({"leaf": ["b", "a"], "a": ["top"], "b": ["top"]}, ["leaf"]) == ["leaf", "a", "b", "top"]
    assert G.would_cycle(edges, "leaf", "top") and not G.would_cycle(edges, "top", "leaf") and G.would_cycle(edges, "a", "a")


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_edges_that_close_a_cycle_are_rejected(spark):
    from loomgraph.operators.rules import CycleError, add_edges

    of = lambda *x: spark.createDataFrame(list(x), "parent string, child string")
    assert {tuple(r) for r in add_edges(of(("a", "b")), of(("b", "c"), ("a", "b"))).collect()} == {("a", "b"), ("b", "c")}
    for bad in (("c", "a"), ("b", "b")):
        with pytest.raises(CycleError):
            add_edges(of(("a", "b"), ("b", "c")), of(bad))
