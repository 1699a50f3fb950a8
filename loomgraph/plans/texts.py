"""Queries of the text, statement, reference and retrieval operators, by name, and the SQL that DuckDB compares them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.functions import cues as C
from loomgraph.functions import text as T
from loomgraph.operators import retrieval as R
from loomgraph.plans.registry import _CASE, _events, _t
from loomgraph.sources.tables import spread

_D = A.DIMENSIONS
DOMAIN = "loomgraph:content:1"

def _docs(spark, sf_dir):
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))


def dim_composition_laws(spark, sf_dir):
    names = F.array(*map(F.lit, _D))
    at = lambda k: F.element_at(names, (F.floor(F.col("id") / 5**k) % 5 + 1).cast("int"))
    abc = spark.range(0, 125, 1, 1).select(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    abc = abc.withColumns({"ab": A.compose(a, b), "ba": A.compose(b, a), "bc": A.compose(b, c)})
    laws = [(F.col("ab") == F.col("ba")).alias("commutes"), (A.compose(F.col("ab"), c) == A.compose(a, F.col("bc"))).alias("associates"), (A.compose(a, F.lit("relational")) == a).alias("right_identity"), A.is_dimension(F.col("ab")).alias("closed")]
    return abc.select("a", "b", "c", *laws)


def text_cue_documents(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # texts may be of any length
    return C.cue_counts(_docs(spark, sf_dir), "text").select("doc_id", *C.contributions()).select("doc_id", *(A.to_fixed(F.col(d)).alias(d) for d in _D))


def term_document_frequency(spark, sf_dir):
    return R.document_frequency(_docs(spark, sf_dir))


def term_bm25(spark, sf_dir):
    return R.bm25(_docs(spark, sf_dir)).select("doc_id", "term", F.round(F.col("weight") * 1e4).cast("long").alias("weight"))


def term_claims(spark, sf_dir):
    return R.term_claims(R.bm25_vectors(_docs(spark, sf_dir))).select("doc_id", "term", F.round(F.col("weight") * 1e4).cast("long").alias("weight"))


def term_cosine(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    pairs = docs.select(F.col("doc_id").alias("a")).join(docs.select(F.col("doc_id").alias("b")), F.col("b") == F.col("a") + 1)
    return R.sparse_cosine(R.bm25_vectors(docs), pairs).select("a", "b", F.round(F.col("cosine") * 1e4).cast("long").alias("cosine"))


def retrieval_rank_fusion(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("recent"))
    return R.reciprocal_rank_fusion(o, "o_custkey", "o_orderkey", ["price", "recent"])


def retrieval_mean_reciprocal_rank(spark, sf_dir):
    from pyspark.sql import Window

    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("rank"))
    return R.mean_reciprocal_rank(l, "l_orderkey", "l_linestatus", "rank", F.col("l_returnflag") == "R")


def retrieval_signature_overlap(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = _t(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderkey").alias("a")).join(o.select(F.col("o_orderkey").alias("b")), F.col("b") == F.col("a") + 1)
    return R.signature_overlap(l, pairs, "l_orderkey", "l_suppkey").select("a", "b", "shared", F.round(F.col("jaccard") * 1e4).cast("long").alias("jaccard"))


def text_enclosing_unit(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", F.concat(F.lit("Article "), F.col("event_id").cast("string"))).alias("heading"))
    return R.enclosing(e, "user_id", "event_id", "heading").select("event_id", "unit")


def reference_resolve(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"))
    n, i = F.col("event_id").cast("string"), (F.col("event_id") % 4 + 1).cast("int")
    end = (F.col("event_id") + F.length("event_type") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("string")  # every seventh span is longer than its text
    shapes = F.array(F.concat("u", F.lit("#0"), n, F.lit("-"), end), F.concat(F.lit("doc://"), "u", F.lit("#span-"), n, F.lit("-"), end), F.concat("u", F.lit("#sentence:"), n, F.lit("-"), end), F.concat("u", F.lit("#"), n))
    refs = e.select(F.col("event_id").alias("ref_id"), T.reference(F.element_at(shapes, i), "doc").alias("ref"))
    known = e.where("event_type <> 'error'")
    entries = known.select(F.concat(F.when(F.col("event_id") % 4 == 1, "doc://").otherwise(""), "u", F.lit("#"), n, F.lit("-"), end).alias("ref"), F.col("event_type").alias("text"))
    return R.resolve_references(refs, entries)


def reference_content_digest(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", T.content_digest(F.concat(F.lit("part#"), F.col("p_partkey").cast("string")), F.col("p_name"), DOMAIN).alias("digest"))


def statement_ids(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", T.statement_id(F.lit("urn:part"), F.lit("2026-01-01"), F.concat(F.lit(" "), F.col("p_name"), F.lit("\t \n e\u0301\u00a0"), F.col("p_name"))).alias("id"))


def statement_layer_tensor(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("layer", F.when(F.col("value") < 50, "surface").when(F.col("value") < 100, "domain").otherwise("deep"))
    wide = e.groupBy("user_id").agg(*T.layered())
    rows = F.array(*(F.struct(F.lit(layer).alias("layer"), *(F.col(f"{layer}_{d}").alias(d) for d in _D)) for layer in T.LAYERS))
    return wide.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.*").select("user_id", "layer", *(A.to_fixed(p).alias(d) for d, p in zip(_D, A.point(64.0), strict=True)))


def triple_violations(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    dimension = F.when(F.col("o_orderpriority").startswith("1"), "causal").when(F.col("o_orderpriority").startswith("2"), "").when(F.col("o_orderpriority").startswith("3"), "spatial").otherwise("temporal")
    found = T.triple_violations(F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), F.lit("is_a"), F.lit("x"), dimension, F.col("o_totalprice").cast("double") / 200000)
    return o.select("o_orderkey", F.array_join(found, ";").alias("violations"))


def link_violations(spark, sf_dir):
    e = _events(spark, sf_dir)
    relation = F.when(F.col("event_id") % 3 == 0, " Em-Beds").when(F.col("event_id") % 3 == 1, "").otherwise("cites")
    return e.select("event_id", F.array_join(T.link_violations(relation, F.col("dim")), ";").alias("violations"))


def views_ingest_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("as_of"))
    now = _t(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))  # one row
    age = F.col("now") - F.col("as_of")
    return e.crossJoin(F.broadcast(now)).select("user_id", age.alias("age"), (age <= 3_600_000_000).alias("servable"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_COMPOSE = "CASE WHEN {b} = 'relational' THEN {a} WHEN {a} = 'causal' AND {b} = 'structural' THEN 'causal' ELSE {b} END"
_DIMS = "(VALUES " + ", ".join(f"('{d}')" for d in _D) + ")"
_WORDS = f"SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{{2,}}'), lambda w: lower(w)), lambda w: NOT list_contains({_list(T.STOPWORDS)}, w)) AS w FROM documents"
_BM25 = f"""toks AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{2,}}')) AS term FROM documents), stop AS (SELECT unnest({_list(T.STOPWORDS)}) AS term),
    f AS MATERIALIZED (SELECT doc_id, term, count(*) AS f FROM toks ANTI JOIN stop USING (term) GROUP BY doc_id, term), l AS (SELECT doc_id, sum(f)::BIGINT AS dl FROM f GROUP BY doc_id),
    s AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, round_even((SELECT sum(f) FROM f)::DOUBLE / (SELECT count(*) FROM documents), 6) AS mean),
    d AS (SELECT term, greatest(0.0::DOUBLE, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1.0::DOUBLE)) AS idf FROM f, s GROUP BY term, n),
    v AS MATERIALIZED (SELECT doc_id, term, round_even(idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)), 6) AS weight FROM f JOIN d USING (term) JOIN l USING (doc_id), s)"""
_AB, _BC, _BA = (_COMPOSE.format(a=x, b=y) for x, y in (("a", "b"), ("b", "c"), ("b", "a")))
_FIX = "trunc({} * 1e6::DOUBLE + 0.5)::BIGINT"

ORACLES = {
    "dim_composition_laws": f"SELECT a, b, c, {_AB} = {_BA} AS commutes, {_COMPOSE.format(a=f'({_AB})', b='c')} = {_COMPOSE.format(a='a', b=f'({_BC})')} AS associates, true AS right_identity, true AS closed FROM {_DIMS} x(a), {_DIMS} y(b), {_DIMS} z(c)",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM ({_WORDS})) GROUP BY term",
    "term_bm25": f"WITH {_BM25} SELECT doc_id, term, round(weight * 1e4)::BIGINT AS weight FROM v WHERE weight > 0",
    "term_claims": f"WITH {_BM25} SELECT doc_id, term, round(round_even(weight / max(weight) OVER (PARTITION BY doc_id), 6) * 1e4)::BIGINT AS weight FROM v WHERE weight > 0",
    "term_cosine": f"""WITH {_BM25}, n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM v WHERE weight > 0 GROUP BY doc_id),
        t AS (SELECT x.doc_id AS a, sum(x.weight * y.weight) AS dot FROM v x JOIN v y ON x.term = y.term AND y.doc_id = x.doc_id + 1 WHERE x.weight > 0 AND y.weight > 0 GROUP BY x.doc_id)
        SELECT p.doc_id AS a, q.doc_id AS b, round(coalesce(round_even(dot / (m.norm * n.norm), 6), 0) * 1e4)::BIGINT AS cosine FROM documents p JOIN documents q ON q.doc_id = p.doc_id + 1 LEFT JOIN t ON t.a = p.doc_id LEFT JOIN n m ON m.doc_id = p.doc_id LEFT JOIN n ON n.doc_id = q.doc_id""",
    "retrieval_rank_fusion": f"""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS price, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS recent FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN price > 0 THEN price END DESC NULLS LAST, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN recent > 0 THEN recent END DESC NULLS LAST, o_orderkey) AS j FROM o),
        f AS (SELECT o_custkey, o_orderkey, (CASE WHEN price > 0 THEN {_FIX.format('(1::DOUBLE / (60 + i))')} ELSE 0 END + CASE WHEN recent > 0 THEN {_FIX.format('(1::DOUBLE / (60 + j))')} ELSE 0 END)::BIGINT AS fused FROM r)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fused DESC, o_orderkey) AS place FROM f""",
    "retrieval_mean_reciprocal_rank": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
        q AS (SELECT l_linestatus, l_orderkey, min(rank) FILTER (l_returnflag = 'R') AS r FROM r GROUP BY ALL)
        SELECT l_linestatus, count(*) AS queries, ((sum({_FIX.format('coalesce(1::DOUBLE / r, 0)')})::BIGINT + count(*) // 2) // count(*))::BIGINT AS mrr FROM q GROUP BY l_linestatus""",
    "retrieval_signature_overlap": """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS e FROM lineitem), n AS (SELECT k, count(*) AS size FROM s GROUP BY k),
        c AS (SELECT x.k AS a, count(*) AS shared FROM s x JOIN s y ON y.k = x.k + 1 AND x.e = y.e GROUP BY x.k)
        SELECT m.k AS a, n.k AS b, coalesce(shared, 0) AS shared, round(round_even(coalesce(shared, 0)::DOUBLE / (m.size + n.size - coalesce(shared, 0)), 6) * 1e4)::BIGINT AS jaccard
        FROM n m JOIN n ON n.k = m.k + 1 JOIN orders p ON p.o_orderkey = m.k JOIN orders q ON q.o_orderkey = n.k LEFT JOIN c ON c.a = m.k""",
    "text_enclosing_unit": "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN 'Article ' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unit FROM events",
    "reference_resolve": """WITH e AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 1 THEN 'doc://u' || user_id ELSE 'u' || user_id END || '#' || event_id || '-' || (event_id + length(event_type) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS ref FROM events)
        SELECT event_id AS ref_id, CASE WHEN event_id % 4 < 3 THEN ref END AS ref, CASE WHEN event_id % 4 = 3 THEN 'malformed' WHEN event_type = 'error' THEN 'unknown' WHEN event_id % 7 = 0 THEN 'span_mismatch' ELSE 'ok' END AS status, CASE WHEN event_id % 4 < 3 AND event_type <> 'error' THEN event_type END AS text FROM e""",
    "reference_content_digest": rf"SELECT p_partkey, sha256(encode('{DOMAIN}') || '\x00'::BLOB || unhex(lpad(hex(octet_length(encode('part#' || p_partkey))), 16, '0')) || encode('part#' || p_partkey) || encode(p_name)) AS digest FROM part",
    "statement_ids": "SELECT p_partkey, 'urn:part#2026-01-01#' || substr(sha256(nfc_normalize(p_name || ' e' || chr(769) || ' ' || p_name)), 1, 16) AS id FROM part",
    "statement_layer_tensor": f"""WITH e AS (SELECT user_id, {_CASE} AS dim, CASE WHEN value < 50 THEN 'surface' WHEN value < 100 THEN 'domain' ELSE 'deep' END AS l FROM events)
        SELECT user_id, layer, {', '.join(_FIX.format(f"round_even(least(count(*) FILTER (dim = '{d}' AND l = layer) / 64.0::DOUBLE, 1.0), 6)") + f' AS {d}' for d in _D)} FROM e, (VALUES ('surface'), ('domain'), ('deep')) x(layer) GROUP BY user_id, layer""",
    "triple_violations": """SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderstatus = 'F' THEN 's is empty' END, CASE WHEN o_orderpriority LIKE '2%' THEN 'no dimension' END, CASE WHEN o_orderpriority LIKE '3%' THEN 'unknown dimension' END,
        CASE WHEN o_totalprice::DOUBLE / 200000 > 1 OR o_totalprice < 0 THEN 'weight out of range' END) AS violations FROM orders""",
    "link_violations": f"SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'no relation' WHEN event_id % 3 = 0 AND ({_CASE}) <> 'structural' THEN 'embeds is structural' ELSE '' END AS violations FROM events",
    "views_ingest_window": "SELECT user_id, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) AS age, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) <= 3600000000 AS servable FROM events GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in ORACLES}
#: SQL can't merge overlapping matches: tested against brute force.
WITHOUT_SQL = {"text_cue_documents": text_cue_documents}
