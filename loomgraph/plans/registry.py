"""All queries of the graph and coordinate operators, by name, and the SQL that DuckDB compares them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.operators import folds as O
from loomgraph.operators import graph as G
from loomgraph.operators import rules as R
from loomgraph.operators import windows as W

_D = A.DIMENSIONS
_CASE = "CASE event_type WHEN 'view' THEN 'structural' WHEN 'error' THEN 'causal' WHEN 'purchase' THEN 'intentional' WHEN 'click' THEN 'temporal' ELSE 'relational' END"
SALT = "round"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.expr(_CASE).alias("dim"))


def _counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(*A.contributions(F.col("dim")))


def _millionths(cols):
    return [A.to_fixed(F.col(d)).alias(d) for d in cols]


def _embeds(spark, sf_dir):
    n, c, o = (_t(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
        .union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
        .union(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    )


def dim_compose_table(spark, sf_dir):
    names = F.array(*map(F.lit, _D))
    ab = spark.range(0, 25, 1, 1).select(F.element_at(names, (F.floor(F.col("id") / 5) + 1).cast("int")).alias("a"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("b"))
    return ab.select("a", "b", A.compose(F.col("a"), F.col("b")).alias("result"))


def dim_left_fold(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(A.left_fold(F.struct("ts", "event_id"), F.col("dim")).alias("dimension"))


def dim_compose_weights(spark, sf_dir):
    w = (F.col("event_id") % 10 + 90) / F.lit(100.0)
    return _events(spark, sf_dir).groupBy("user_id").agg(A.product(w).alias("weight"))


def coords_position(spark, sf_dir):
    return _counts(spark, sf_dir).select("user_id", A.dominant().alias("dominant"), A.basis().alias("basis"), *A.shares()).select("user_id", "dominant", "basis", *_millionths(_D))


def coords_point(spark, sf_dir):
    return _counts(spark, sf_dir).select("user_id", *A.point(64.0)).select("user_id", *_millionths(_D))


def coords_cosine(spark, sf_dir):
    c = _counts(spark, sf_dir)
    p, q = c.alias("p"), c.select((F.col("user_id") - 1).alias("user_id"), *_D).alias("q")
    both = p.join(q, F.col("p.user_id") == F.col("q.user_id"))
    return both.select(F.col("p.user_id").alias("user_id"), F.round(A.cosine([F.col(f"p.{d}").cast("double") for d in _D], [F.col(f"q.{d}").cast("double") for d in _D]) * 1e4).cast("long").alias("cosine"))


def coords_with_embeds(spark, sf_dir):
    held = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("held"))
    return _counts(spark, sf_dir).join(held, "user_id", "full").select("user_id", *A.with_embeds(F.col("held")))


def fixed_point(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    x = A.to_fixed(F.col("l_extendedprice").cast("double") * F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(-1.0))
    s = l.groupBy("l_suppkey").agg(F.sum(x).alias("total"), F.count("*").alias("n"))
    return s.select("l_suppkey", "total", A.fixed_mean(F.col("total"), F.col("n")).alias("mean"))


def match_combine_scores(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") * 10).alias("t"), (F.col("l_tax").cast("double") * 10).alias("s"))
    return l.select("l_orderkey", "l_linenumber", F.round(A.combine_scores(F.least("t", F.lit(1.0)), F.least("s", F.lit(1.0))) * 1e4).cast("long").alias("score"))


def _members(spark, sf_dir):
    c = _counts(spark, sf_dir).select("user_id", *A.point(64.0))
    return c.withColumn("container", F.col("user_id") % 37)


def coords_container_position(spark, sf_dir):
    return G.container_position(_members(spark, sf_dir), "container")


def container_trimmed_top_k(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("container"), F.col("o_orderkey").alias("claim"), F.floor(F.col("o_totalprice") / 1000).alias("weight"))
    return G.trimmed_top_k(o, "container", "claim", "weight", 5, 3, SALT).select("container", "claim", F.col("rank").cast("long").alias("rank"))


def container_member_digest(spark, sf_dir):
    return O.member_digests(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 1)


def dag_reverse_index(spark, sf_dir):
    return G.reverse_index(_embeds(spark, sf_dir)).select("node", F.array_join("parents", ",").alias("parents"))


def dag_reachable(spark, sf_dir):
    regions = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return G.reachable(_embeds(spark, sf_dir), regions).groupBy("start", "hops").agg(F.count("*").alias("nodes"))


def depth_link_signal(spark, sf_dir):
    return G.link_signal(_links(spark, sf_dir), "concept", 2)


def _links(spark, sf_dir):
    """Customers link to others by their orders, and to the months of these as anchors."""
    n = _t(spark, sf_dir, "customer").agg(F.count("*").alias("n"))  # one row
    o = _t(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    concept = o.select(c.alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") % F.col("n")).cast("string")).alias("dst"), F.lit("concept").alias("kind"))
    return concept.union(o.select(F.concat(F.lit("m"), F.month("o_orderdate").cast("string")), c, F.lit("anchor")))


def depth_conceptual(spark, sf_dir):
    every = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return R.conceptual_depth(every, _links(spark, sf_dir), _embeds(spark, sf_dir)).select("node", F.round(F.col("depth") * 1e4).cast("long").alias("depth"))


def depth_quantiles(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return G.quantiles(c, "c_nationkey", "c_acctbal").select("c_custkey", F.round(F.col("quantile") * 1e4).cast("long").alias("quantile"))


def container_trimmed_match(spark, sf_dir):
    m = _members(spark, sf_dir).join(_t(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.sum("value") / 100).alias("weight")), "user_id")
    found = G.trimmed_match(m, "container", "user_id", "weight", 4, 3, SALT)
    return found.withColumn("claims", F.array_join(F.transform("claims", lambda x: x.cast("string")), ","))


def path_typed_search(spark, sf_dir):
    """Nations lead to their customers, and these to others by their orders, whose numbers give the weight."""
    n, c = (_t(spark, sf_dir, x) for x in ("nation", "customer"))
    every = c.agg(F.count("*").alias("n"))  # one row
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    d = F.element_at(F.array(*map(F.lit, _D)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = _t(spark, sf_dir, "orders").crossJoin(F.broadcast(every)).select(name("c", F.col("o_custkey")).alias("source"), name("c", F.col("o_orderkey") % F.col("n")).alias("target"), d.alias("dimension"), ((F.col("o_orderkey") % 7 + 2) / F.lit(10.0)).alias("weight"))
    down = c.select(name("n", F.col("c_nationkey")), name("c", F.col("c_custkey")), F.lit("structural"), F.lit(0.9))
    top = n.select(F.lit("r"), name("n", F.col("n_nationkey")), F.lit("causal"), F.lit(1.0))
    return G.typed_path_search(o.union(down).union(top), "r", 0.25)


def statement_raw_contributions(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.explode(F.array_distinct(F.array(F.col("user_id"), F.col("event_id") % 50))).alias("entry"), "dim")
    return e.groupBy("entry").agg(*A.contributions(F.col("dim")))


def views_position_digest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("member"))
    held = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("member"))
    return O.position_digests(e, held, "user_id", "member", "p")


def views_stale_ancestors(spark, sf_dir):
    changed = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return G.stale_ancestors(_embeds(spark, sf_dir), changed).select("node", F.col("level").cast("long").alias("level"))


def views_debounce(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return W.debounced(e, "user_id", "t", 86400.0, 5)


def relation_key(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", A.relation_key(F.concat_ws("_", F.lit(" Is"), "p_name", F.lit("Of-"))).alias("key"))


def relational_effective(spark, sf_dir):
    return _counts(spark, sf_dir).select("user_id", F.round(A.relational_effective(F.col("relational").cast("double"), (F.col("structural") + F.col("causal") + F.col("intentional") + F.col("temporal")).cast("double")) * 1e4).cast("long").alias("effective"))


_EV = f"SELECT event_id, user_id, ts, value, {_CASE} AS dim FROM events"
_CO = f"SELECT user_id, {', '.join(f"count(*) FILTER (dim = '{d}') AS {d}" for d in _D)} FROM ({_EV}) GROUP BY user_id"
_EMB = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"
_LNK = "SELECT DISTINCT 'c' || o_custkey AS src, 'c' || (o_orderkey % (SELECT count(*) FROM customer)) AS dst FROM orders"
_TWO = f"l AS ({_LNK}), two AS (SELECT src, dst FROM l UNION SELECT x.src, y.dst FROM l x JOIN l y ON x.dst = y.src)"
_SUM = " + ".join(_D)
_DIMS = "(VALUES " + ", ".join(f"('{d}')" for d in _D) + ")"
_COMPOSE = "CASE WHEN {b} = 'relational' THEN {a} WHEN {a} = 'causal' AND {b} = 'structural' THEN 'causal' ELSE {b} END"
_PT = ", ".join(f"round_even(least({d} / 64.0::DOUBLE, 1.0), 6) AS {d}" for d in _D)


def _fx(d):
    return f"CASE WHEN {d} * 1e6::DOUBLE >= 0 THEN trunc({d} * 1e6::DOUBLE + 0.5)::BIGINT ELSE -trunc(-({d} * 1e6::DOUBLE) + 0.5)::BIGINT END"


ORACLES = {
    "dim_compose_table": f"SELECT a, b, {_COMPOSE.format(a='a', b='b')} AS result FROM {_DIMS} x(a), {_DIMS} y(b)",
    "dim_left_fold": f"SELECT user_id, list_reduce(list_prepend('relational', list(dim ORDER BY ts, event_id)), lambda a, b: {_COMPOSE.format(a='a', b='b')}) AS dimension FROM ({_EV}) GROUP BY user_id",
    "dim_compose_weights": "SELECT user_id, round_even(product((event_id % 10 + 90) / 100.0::DOUBLE), 6) AS weight FROM events GROUP BY user_id",
    "coords_position": f"SELECT user_id, CASE WHEN greatest({', '.join(_D)}) <= 0 THEN 'relational' {' '.join(f"WHEN {d} = greatest({', '.join(_D)}) THEN '{d}'" for d in _D)} END AS dominant, CASE WHEN greatest({', '.join(_D)}) > 0 THEN 'planes' ELSE 'default' END AS basis, {', '.join(f'{_fx(f"(CASE WHEN {_SUM} = 0 THEN 0 ELSE round_even({d} / ({_SUM})::DOUBLE, 6) END)")} AS {d}' for d in _D)} FROM ({_CO})",
    "coords_point": f"SELECT user_id, {', '.join(f'{_fx(d)} AS {d}' for d in _D)} FROM (SELECT user_id, {_PT} FROM ({_CO}))",
    "coords_cosine": f"WITH c AS ({_CO}) SELECT p.user_id, round(CASE WHEN sqrt({' + '.join(f'p.{d} * p.{d}' for d in _D)}) * sqrt({' + '.join(f'q.{d} * q.{d}' for d in _D)}) = 0 THEN 0 ELSE round_even(({' + '.join(f'p.{d} * q.{d}' for d in _D)}) / (sqrt({' + '.join(f'p.{d} * p.{d}' for d in _D)}) * sqrt({' + '.join(f'q.{d} * q.{d}' for d in _D)})), 6) END * 1e4)::BIGINT AS cosine FROM c p JOIN c q ON q.user_id = p.user_id + 1",
    "coords_with_embeds": f"SELECT user_id, coalesce(structural, 0) + coalesce(held, 0) AS structural, {', '.join(f'coalesce({d}, 0) AS {d}' for d in _D[1:])} FROM ({_CO}) FULL JOIN (SELECT o_custkey AS user_id, count(*) AS held FROM orders GROUP BY 1) USING (user_id)",
    "fixed_point": f"SELECT l_suppkey, t::BIGINT AS total, (CASE WHEN t >= 0 THEN (t + n // 2) // n ELSE -((-t + n // 2) // n) END)::BIGINT AS mean FROM (SELECT l_suppkey, sum({_fx('(l_extendedprice::DOUBLE * CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END)')})::BIGINT AS t, count(*) AS n FROM lineitem GROUP BY l_suppkey)",
    "match_combine_scores": "SELECT l_orderkey, l_linenumber, round(round_even((least(l_discount::DOUBLE * 10, 1.0) * 0.7::DOUBLE + least(l_tax::DOUBLE * 10, 1.0) * 0.3::DOUBLE) / 1.0, 6) * 1e4)::BIGINT AS score FROM lineitem",
    "coords_container_position": f"SELECT container, {', '.join(f'((t_{d} + n // 2) // n)::BIGINT AS {d}' for d in _D)} FROM (SELECT user_id % 37 AS container, count(*) AS n, {', '.join(f'sum({_fx(d)})::BIGINT AS t_{d}' for d in _D)} FROM (SELECT user_id, {_PT} FROM ({_CO})) GROUP BY 1)",
    "container_trimmed_top_k": f"SELECT container, claim, rank FROM (SELECT o_custkey AS container, o_orderkey AS claim, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, sha256('{SALT}|' || o_orderkey)) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n < 3 OR rank <= 5",
    "container_member_digest": """SELECT o_custkey, sha256('{"members":["' || array_to_string(list_sort(list_distinct(list(o_orderkey::VARCHAR))), '","') || '"],"version":1}') AS digest FROM orders GROUP BY o_custkey""",
    "dag_reverse_index": f"WITH e AS ({_EMB}) SELECT node, coalesce(parents, '') AS parents FROM (SELECT parent AS node FROM e UNION SELECT child FROM e) LEFT JOIN (SELECT child AS node, string_agg(DISTINCT parent, ',' ORDER BY parent) AS parents FROM e GROUP BY child) USING (node)",
    "dag_reachable": f"WITH RECURSIVE e AS ({_EMB}), r(start, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT start, child, hops + 1 FROM r JOIN e ON r.node = e.parent) SELECT start, hops::INTEGER AS hops, count(*) AS nodes FROM r GROUP BY start, hops",
    "depth_link_signal": f"WITH {_TWO} SELECT dst AS node, count(*) AS signal FROM two WHERE src <> dst GROUP BY dst",
    "container_trimmed_match": f"""WITH m AS (SELECT user_id, user_id % 37 AS container, {', '.join(f'{_fx(d)} AS {d}' for d in _D)} FROM (SELECT user_id, {_PT} FROM ({_CO}))),
        w AS (SELECT user_id, floor(sum(value) / 100) AS weight FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY weight DESC, sha256('{SALT}|' || user_id)) AS rank FROM m JOIN w USING (user_id))
        SELECT container, string_agg(user_id::VARCHAR, ',' ORDER BY rank) AS claims, {', '.join(f'((sum({d}) + count(*) // 2) // count(*))::BIGINT AS {d}' for d in _D)} FROM r WHERE rank <= 4 GROUP BY container""",
    "depth_conceptual": f"""WITH {_TWO}, k AS (SELECT dst AS node, count(*)::DOUBLE AS k FROM two WHERE src <> dst GROUP BY dst), a AS (SELECT 'c' || o_custkey AS node, count(DISTINCT month(o_orderdate))::DOUBLE AS a FROM orders GROUP BY 1),
        e AS ({_EMB}), t AS (SELECT parent, child FROM e UNION SELECT x.parent, y.child FROM e x JOIN e y ON x.child = y.parent), u AS (SELECT child AS node, count(*)::DOUBLE AS up FROM t GROUP BY child), w AS (SELECT parent AS node, count(*)::DOUBLE AS down FROM t GROUP BY parent),
        s AS (SELECT 'c' || c_custkey AS node, coalesce(k, 0) AS k, coalesce(a, 0) AS a, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM customer LEFT JOIN k ON k.node = 'c' || c_custkey LEFT JOIN a ON a.node = 'c' || c_custkey LEFT JOIN u ON u.node = 'c' || c_custkey LEFT JOIN w ON w.node = 'c' || c_custkey)
        SELECT node, round(round_even(least(greatest((0.5::DOUBLE * (k / (k + 5.0::DOUBLE)) * (1 - a / (a + 2.0::DOUBLE)) + 0.5::DOUBLE * CASE WHEN up + down > 0 THEN up / (up + down) ELSE 0 END) / 1.0, 0.0), 1.0), 6) * 1e4)::BIGINT AS depth FROM s""",
    "depth_quantiles": "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) * 1e4)::BIGINT AS quantile FROM customer",
    "path_typed_search": f"""WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS source, 'c' || (o_orderkey % (SELECT count(*) FROM customer)) AS target, [{', '.join(f"'{d}'" for d in _D)}][(o_orderkey % 5 + 1)::BIGINT] AS dimension, (o_orderkey % 7 + 2) / 10.0::DOUBLE AS weight FROM orders
            UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'structural', 0.9::DOUBLE FROM customer UNION SELECT 'r', 'n' || n_nationkey, 'causal', 1.0::DOUBLE FROM nation),
        p(node, dimension, weight, hops) AS (SELECT 'r', 'relational', 1.0::DOUBLE, 0 UNION SELECT e.target, {_COMPOSE.format(a='p.dimension', b='e.dimension')}, p.weight * e.weight, p.hops + 1 FROM p JOIN e ON p.node = e.source WHERE p.weight * e.weight >= 0.25),
        b AS (SELECT node, dimension, max(weight) AS weight FROM p GROUP BY node, dimension)
        SELECT node, dimension, weight, min(hops)::INTEGER AS hops FROM b JOIN p USING (node, dimension, weight) GROUP BY node, dimension, weight""",
    "statement_raw_contributions": f"SELECT entry, {', '.join(f"count(*) FILTER (dim = '{d}') AS {d}" for d in _D)} FROM (SELECT unnest(list_distinct([user_id, event_id % 50])) AS entry, dim FROM ({_EV})) GROUP BY entry",
    "views_position_digest": """WITH c AS (SELECT user_id, string_agg('"' || event_id || '"', ',' ORDER BY event_id::VARCHAR) AS c FROM events GROUP BY user_id), h AS (SELECT o_custkey AS user_id, string_agg('"' || o_orderkey || '"', ',' ORDER BY o_orderkey::VARCHAR) AS h FROM orders GROUP BY 1)
        SELECT user_id, sha256('{"claims":[' || coalesce(c, '') || '],"embeds":[' || coalesce(h, '') || '],"profile_digest":"p"}') AS digest FROM c FULL JOIN h USING (user_id)""",
    "views_stale_ancestors": f"WITH RECURSIVE e AS ({_EMB}), r(node, level) AS (SELECT 'o' || o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P' UNION SELECT parent, level + 1 FROM r JOIN e ON r.node = e.child) SELECT node, max(level)::BIGINT AS level FROM r GROUP BY node",
    "views_debounce": f"""WITH s AS (SELECT user_id, list(floor(epoch(ts))::DOUBLE ORDER BY floor(epoch(ts))) AS t FROM events GROUP BY user_id),
        f AS (SELECT user_id, list_reduce(list_prepend({{'at': 0.0::DOUBLE, 'n': 0, 'out': 0}}, list_transform(t, lambda x: {{'at': x, 'n': 0, 'out': 0}})), lambda s, x: CASE WHEN s.n > 0 AND x.at - s.at <= 86400 THEN (CASE WHEN s.n + 1 >= 5 THEN {{'at': s.at, 'n': 0, 'out': s.out + 1}} ELSE {{'at': s.at, 'n': s.n + 1, 'out': s.out}} END) ELSE {{'at': x.at, 'n': 1, 'out': s.out + CASE WHEN s.n > 0 THEN 1 ELSE 0 END}} END) AS z FROM s)
        SELECT user_id, (z.out + CASE WHEN z.n > 0 THEN 1 ELSE 0 END)::BIGINT AS flushes FROM f""",
    "relation_key": r"SELECT p_partkey, regexp_replace(lower(' Is_' || p_name || '_Of-'), '[\s_-]+', '', 'g') AS key FROM part",
    "relational_effective": f"SELECT user_id, round(round_even(relational::DOUBLE / (1.0::DOUBLE + structural + causal + intentional + temporal), 6) * 1e4)::BIGINT AS effective FROM ({_CO})",
}
QUERIES = {name: globals()[name] for name in ORACLES}
