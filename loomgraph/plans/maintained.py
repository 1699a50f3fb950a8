"""Queries of what is kept up by batches: the order of the containment graph, running folds, views by deltas; and the SQL that DuckDB compares them with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.operators import evaluation, scan, topology
from loomgraph.plans.registry import _CASE, _EMB, _embeds, _events, _t
from loomgraph.sources.tables import joined, shared_folder, stored
from loomgraph.streaming.views import View, deltas, identical

_D = A.DIMENSIONS


def compose(a: str, b: str) -> str:
    """The composition of two dimensions, of names."""
    return a if b == "relational" or (a, b) == ("causal", "structural") else b


def _name(letter: str, k):
    return F.concat(F.lit(letter), k.cast("string"))


def _batch(spark, sf_dir):
    """New edges: chains of ten customers each, against the order of their names or with it; suppliers and their parts below nations; one node above all regions."""
    c, s, p, r = (_t(spark, sf_dir, x) for x in ("customer", "supplier", "part", "region"))
    chains = joined(c.where("c_custkey % 10 <> 0").select("c_custkey", (F.col("c_custkey") - 1).alias("k")), c.select(F.col("c_custkey").alias("k")), "k", "left_semi")
    chains = chains.select(_name("c", F.col("c_custkey")).alias("parent"), _name("c", F.col("k")).alias("child"))
    n = s.agg(F.max("s_suppkey").alias("n"))  # one row
    parts = joined(p.crossJoin(F.broadcast(n)).select("p_partkey", (F.col("p_partkey") % F.col("n") + 1).alias("s_suppkey")), s.select("s_suppkey"), "s_suppkey", "left_semi")
    parts = parts.select(_name("s", F.col("s_suppkey")), _name("p", F.col("p_partkey")))
    return chains.union(s.select(_name("n", F.col("s_nationkey")), _name("s", F.col("s_suppkey")))).union(parts).union(r.select(F.lit("w"), _name("r", F.col("r_regionkey"))))


def nesting_incremental_order(spark, sf_dir):
    edges = stored(_embeds(spark, sf_dir), "edges")
    before = topology.placed(edges)
    together, after = topology.insert(edges, before, _batch(spark, sf_dir))
    after = stored(after, "places")
    wrong = topology.disordered(together, after).agg(F.count("*").alias("n_disordered"))  # one row
    old = before.select("node", F.col("place").alias("old"))
    return joined(after, old, "node", "left").crossJoin(F.broadcast(wrong)).select("node", "place", F.col("old").isNull().alias("fresh"), (F.col("old") != F.col("place")).alias("moved"), "n_disordered")


def path_running_fold(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("path", F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id")))  # one path has half of all rows
    return scan.running_fold(e.select("path", "ts", "event_id", "dim"), "path", ["ts", "event_id"], "dim", _D, compose, "relational", "dimension").select("event_id", "path", "dimension")


def views_erasure(spark, sf_dir):
    """All events come in four epochs, a tenth goes; the view is proved equal to one built from the survivors alone."""
    e = _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("entry"), "dim")
    view = View(spark, f"{shared_folder(spark)}/view-{uuid.uuid4().hex}")
    for k in range(4):
        view.apply(deltas(e.where(F.col("event_id") % 4 == k), "entry", "dim"), k)
    gone = e.where("event_id % 10 = 3")
    view.fence("open", gone.where("event_id % 100 = 3").select("entry"))  # another request, which stays open
    view.erase("tenth", gone, "entry", "dim", 4)
    view.apply(deltas(e, "entry", "dim"), 2)  # a replay, without effect
    proved = identical(view.sums(), deltas(e.where("event_id % 10 <> 3"), "entry", "dim"))
    served = view.served().select("entry", F.lit(True).alias("served"))
    return view.sums().join(served, "entry", "left").select("entry", F.coalesce("served", F.lit(False)).alias("served"), "n", *_D, F.lit(proved).alias("identical"))


def nesting_would_cycle(spark, sf_dir):
    """Candidates that cover every node: each order as the holder of its customer, of another customer and of a nation; each customer as that of an order and of another customer."""
    edges = stored(_embeds(spark, sf_dir), "edges")
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    n = c.agg(F.max("c_custkey").alias("n"))  # one row
    order, customer = _name("o", F.col("o_orderkey")), _name("c", F.col("o_custkey"))
    o = o.crossJoin(F.broadcast(n)).select("o_orderkey", "o_custkey", (F.col("o_orderkey") % F.col("n") + 1).alias("k"))
    some = o.select(order.alias("parent"), customer.alias("child"))
    for p, q in ((order, _name("c", F.col("k"))), (order, _name("n", F.col("k") % 25)), (_name("c", F.col("k")), order), (customer, _name("c", F.col("k")))):
        some = some.union(o.select(p, q))
    return topology.would_cycle(edges, topology.placed(edges), some.distinct())


def evaluation_sign_flip(spark, sf_dir):
    """Pairs are the months of the year: orders that are filled against those that are open, in hundreds of the currency."""
    o = _t(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice").cast("double") / 100).cast("long")
    months = o.groupBy(F.month("o_orderdate").alias("m")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price).when(F.col("o_orderstatus") == "O", -price).otherwise(0)).alias("d"))
    return evaluation.sign_flip_test(months, "d")


_EV = f"SELECT event_id, user_id, ts, {_CASE} AS dim FROM events"
ORACLES = {
    # The first order by level and name; intervals, what is reached in them both ways, the core by levels, places dealt anew.
    "nesting_incremental_order": f"""
        WITH RECURSIVE e AS ({_EMB}), k AS (SELECT max(s_suppkey) AS n FROM supplier),
        b AS (SELECT 'c' || c_custkey AS parent, 'c' || (c_custkey - 1) AS child FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
              UNION SELECT 's' || (p_partkey % n + 1), 'p' || p_partkey FROM part, k WHERE p_partkey % n + 1 IN (SELECT s_suppkey FROM supplier) UNION SELECT 'w', 'r' || r_regionkey FROM region),
        every AS (SELECT * FROM e UNION SELECT * FROM b), nodes AS (SELECT DISTINCT node FROM (SELECT parent AS node FROM e UNION ALL SELECT child FROM e)),
        lv(node, l) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM e) UNION SELECT child, l + 1 FROM lv JOIN e ON parent = node),
        old AS (SELECT node, row_number() OVER (ORDER BY l, node) - 1 AS place FROM (SELECT node, max(l) AS l FROM lv GROUP BY node)),
        named AS (SELECT node, bool_or(held) AS held FROM (SELECT parent AS node, false AS held FROM b UNION ALL SELECT child, true FROM b) WHERE node NOT IN (SELECT node FROM old) GROUP BY node),
        heads AS (SELECT node, (SELECT min(place) FROM old) - row_number() OVER (ORDER BY node) AS place FROM named WHERE NOT held),
        tails AS (SELECT node, (SELECT max(place) FROM old) + row_number() OVER (ORDER BY substr(node, 1, 1) = 'p' AND node IN (SELECT child FROM b WHERE parent IN (SELECT node FROM named WHERE held)), node) AS place FROM named WHERE held),
        pl AS (SELECT * FROM old UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM tails),
        back AS (SELECT b.*, c.place AS low, p.place AS high FROM b JOIN pl p ON p.node = parent JOIN pl c ON c.node = child WHERE p.place > c.place),
        reach AS (SELECT *, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM back),
        part_of AS (SELECT *, max(CASE WHEN before IS NULL OR low > before THEN low END) OVER (ORDER BY low, high) AS span FROM reach),
        spans AS (SELECT span, max(high) AS until FROM part_of GROUP BY span), region AS (SELECT node, place, span FROM pl JOIN spans ON place BETWEEN span AND until),
        inn AS (SELECT parent, child FROM every JOIN region p ON p.node = parent JOIN region c ON c.node = child WHERE p.span = c.span),
        f(node) AS (SELECT child FROM back UNION SELECT child FROM f JOIN inn ON parent = node), g(node) AS (SELECT parent FROM back UNION SELECT parent FROM g JOIN inn ON child = node),
        core AS (SELECT * FROM f INTERSECT SELECT * FROM g), cl(node, l) AS (SELECT node, 0 FROM core UNION SELECT child, l + 1 FROM cl JOIN inn ON parent = node WHERE child IN (SELECT node FROM core)), cm AS (SELECT node, max(l) AS l FROM cl GROUP BY node),
        moved AS (SELECT node, place, span, CASE WHEN node NOT IN (SELECT node FROM f) THEN 0 WHEN node IN (SELECT node FROM g) THEN 1 ELSE 2 END AS side, coalesce(l, 0) AS l FROM region LEFT JOIN cm USING (node) WHERE node IN (SELECT node FROM f UNION SELECT node FROM g)),
        dealt AS (SELECT x.node, y.place FROM (SELECT node, row_number() OVER (ORDER BY span, side, l, place) AS k FROM moved) x JOIN (SELECT place, row_number() OVER (ORDER BY place) AS k FROM moved) y USING (k))
        SELECT pl.node, coalesce(dealt.place, pl.place)::BIGINT AS place, old.node IS NULL AS fresh, CASE WHEN old.node IS NOT NULL THEN old.place <> coalesce(dealt.place, pl.place) END AS moved, 0::BIGINT AS n_disordered FROM pl LEFT JOIN dealt USING (node) LEFT JOIN old ON old.node = pl.node
    """,
    # By the last element that isn't neutral, and the last before it that isn't structural either.
    "path_running_fold": f"""
        WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS path, ts, dim FROM ({_EV})),
        l AS (SELECT event_id, path, last_value(CASE WHEN dim <> 'relational' THEN dim END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN dim NOT IN ('relational', 'structural') THEN dim END IGNORE NULLS) OVER w AS b FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, path, CASE WHEN a IS NULL THEN 'relational' WHEN a <> 'structural' THEN a WHEN b = 'causal' THEN 'causal' ELSE 'structural' END AS dimension FROM l
    """,
    "nesting_would_cycle": f"""
        WITH RECURSIVE e AS ({_EMB}), n AS (SELECT max(c_custkey) AS n FROM customer), o AS (SELECT o_orderkey, o_custkey, o_orderkey % n + 1 AS k FROM orders, n),
        s AS (SELECT 'o' || o_orderkey AS parent, 'c' || o_custkey AS child FROM o UNION SELECT 'o' || o_orderkey, 'c' || k FROM o UNION SELECT 'o' || o_orderkey, 'n' || (k % 25) FROM o UNION SELECT 'c' || k, 'o' || o_orderkey FROM o UNION SELECT 'c' || o_custkey, 'c' || k FROM o),
        r(node, up) AS (SELECT child, parent FROM e UNION SELECT r.node, e.parent FROM r JOIN e ON e.child = r.up)
        SELECT s.parent, s.child, s.parent = s.child OR r.node IS NOT NULL AS cycle FROM s LEFT JOIN r ON r.node = s.parent AND r.up = s.child
    """,
    # All sign choices, one by one.
    "evaluation_sign_flip": """
        WITH d AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, d FROM (SELECT month(o_orderdate) AS m, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * floor(o_totalprice::DOUBLE / 100)::BIGINT)::BIGINT AS d FROM orders GROUP BY 1)),
        c AS (SELECT unnest(range(1 << (SELECT count(*) FROM d)::INTEGER)) AS c), t AS (SELECT c, sum(CASE WHEN (c >> i) & 1 = 1 THEN -d ELSE d END) AS s FROM c, d GROUP BY c)
        SELECT count(*) FILTER (s >= (SELECT sum(d) FROM d)) AS at_least, count(*) AS total FROM t
    """,
    "views_erasure": f"""
        SELECT user_id::VARCHAR AS entry, user_id NOT IN (SELECT user_id FROM events WHERE event_id % 100 = 3) AS served, count(*) AS n, {', '.join(f"count(*) FILTER (dim = '{d}') AS {d}" for d in _D)}, true AS identical
        FROM ({_EV}) WHERE event_id % 10 <> 3 GROUP BY user_id
    """,
}
QUERIES = {name: globals()[name] for name in ORACLES}
