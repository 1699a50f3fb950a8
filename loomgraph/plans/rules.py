"""Queries of the rule, statement-join and nesting operators, by name, and the SQL that DuckDB compares them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import rules as R
from loomgraph.plans.registry import _CASE, _EMB, _embeds, _events, _t

RULES = [("o1", ["view"], ["click", "purchase"]), ("o2", ["signup", "error"], ["error"]), ("o3", ["none"], ["view"])]


def requirement_check(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    tags = e.select("user_id", F.col("event_type").alias("concept"), (F.col("value") > 150).alias("affirmed"))
    rules = spark.createDataFrame(RULES, "obligation_id string, trigger_concepts array<string>, required_concepts array<string>")
    users = e.select("user_id").distinct()
    found = R.check_requirements(users, "user_id", R.concept_states(tags, "user_id"), rules)
    joined = [F.array_join(c, ",").alias(c) for c in ("present", "uncertain", "missing")]
    return found.select("user_id", "obligation_id", "triggered", "trigger_uncertain", *joined, "all_present", "needs_review")


def statement_dual_splits(spark, sf_dir):
    e = _events(spark, sf_dir)
    day = F.to_date("ts")
    s = e.select("user_id", F.col("event_id").alias("id"), F.col("dim").alias("dimension"), day.cast("string").alias("subj"), day.cast("string").alias("obj"), F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value")).alias("end"))
    return R.dual_splits(s, "user_id")


def depth_nesting_position(spark, sf_dir):
    return R.nesting_position(_embeds(spark, sf_dir)).select("node", F.round(F.col("position") * 1e4).cast("long").alias("position"))


def statement_violations(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 16
    at = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    c = {
        "id": at(0, F.lit(""), at(1, F.lit("a#b"), F.lit("u#d#0123456789abcdef"))), "subj": at(2, F.lit(None).cast("string"), F.lit("s")), "obj": at(3, F.lit(""), F.lit("o")),
        "predicate": at(4, F.lit(""), at(5, F.lit("likes"), F.lit("is_a"))), "dimension": at(6, F.lit(None).cast("string"), at(7, F.lit("spatial"), at(8, F.lit("causal"), F.lit("structural")))),
        "layer": at(9, F.lit("high"), F.lit("deep")), "weight": at(10, F.lit(1.5), at(11, F.lit(None).cast("double"), F.lit(0.5))), "edge_confidence": at(12, F.lit(None).cast("double"), F.lit(0.5)),
        "start": at(13, F.lit(-1), F.lit(3)), "end": at(14, F.lit(3), F.lit(5)), "negation": at(15, F.lit("no"), F.lit("absent")),
    }
    return e.select("event_id", F.array_join(R.statement_violations(c), ";").alias("violations"))


def statement_split_violations(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 5
    pairs = e.select("event_id", F.when(k == 1, "temporal").otherwise("causal").alias("c_dimension"), F.when(k == 2, "temporal").otherwise("intentional").alias("i_dimension"), F.lit("m").alias("c_obj"),
        F.when(k == 3, "x").otherwise("m").alias("i_subj"), F.lit(0).alias("c_start"), F.lit(9).alias("c_end"), F.when(k == 4, 10).otherwise(9).alias("i_start"), F.lit(20).alias("i_end"))
    return R.dual_split_violations(pairs).select("event_id", F.array_join("violations", ";").alias("violations"))


def _arr(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_RULES = "(VALUES " + ", ".join(f"('{o}', {_arr(t)}, {_arr(q)})" for o, t, q in RULES) + ") r(obligation_id, t, q)"
_STATE = "list_sort(list_filter(q, lambda c: {}))"

ORACLES = {
    "requirement_check": f"""WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 150) AS p0, list(DISTINCT event_type) AS m FROM events GROUP BY user_id), h AS (SELECT user_id, coalesce(p0, []) AS p, m FROM s),
        x AS (SELECT user_id, obligation_id, list_has_any(t, p) AS triggered, len(list_filter(t, lambda c: list_contains(m, c) AND NOT list_contains(p, c))) > 0 AS maybe,
            {_STATE.format('list_contains(p, c)')} AS pr, {_STATE.format('list_contains(m, c) AND NOT list_contains(p, c)')} AS un, {_STATE.format('NOT list_contains(m, c)')} AS mi FROM h, {_RULES})
        SELECT user_id, obligation_id, triggered, NOT triggered AND maybe AS trigger_uncertain, array_to_string(pr, ',') AS present, array_to_string(un, ',') AS uncertain, array_to_string(mi, ',') AS missing,
            CASE WHEN triggered THEN len(un) = 0 AND len(mi) = 0 END AS all_present, len(un) > 0 OR (NOT triggered AND maybe) AS needs_review FROM x""",
    "statement_dual_splits": f"""WITH s AS (SELECT user_id, event_id AS id, {_CASE} AS dim, ts::DATE AS day, event_id AS a, event_id + floor(value) AS b FROM events)
        SELECT c.user_id, c.id AS causal, i.id AS intentional FROM s c JOIN s i ON c.user_id = i.user_id AND c.day = i.day AND c.dim = 'causal' AND i.dim = 'intentional' AND c.b >= i.a AND i.b >= c.a""",
    "depth_nesting_position": f"""WITH e AS ({_EMB}), two AS (SELECT parent, child FROM e UNION SELECT x.parent, y.child FROM e x JOIN e y ON x.child = y.parent),
        u AS (SELECT child AS node, count(*) AS up FROM two GROUP BY child), d AS (SELECT parent AS node, count(*) AS down FROM two GROUP BY parent)
        SELECT node, round(coalesce(up, 0)::DOUBLE / (coalesce(up, 0) + coalesce(down, 0)) * 1e4)::BIGINT AS position FROM u FULL JOIN d USING (node)""",
    "statement_violations": """SELECT event_id, ['id is empty', 'the id is not uri#date#hash', 'subj is empty', 'obj is empty', 'predicate is empty', 'unknown predicate', 'no dimension', 'unknown dimension', 'not the predicate''s dimension',
        'unknown layer', 'weight out of range', '', 'no edge_confidence within 0 and 1', 'no start of 0 or more', 'the span is empty', 'unknown negation'][event_id % 16 + 1] AS violations FROM events""",
    "statement_split_violations": "SELECT event_id, ['', 'the first is not causal', 'the second is not intentional', 'no shared middle', 'the spans are apart'][event_id % 5 + 1] AS violations FROM events",
}
QUERIES = {name: globals()[name] for name in ORACLES}
