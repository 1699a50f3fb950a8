"""Queries of the text, grammar, document and replay operators. Their texts are made from whole rows of events in Spark and DuckDB alike, so the SQL says by rule what each text holds; over documents, whose prose is invented, the same
operators run on whole texts and are tested against plain versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import documents as D
from loomgraph.extract import build, outline, references, replay
from loomgraph.functions import algebra as A
from loomgraph.functions import citations as C
from loomgraph.functions import lowering as L
from loomgraph.functions import text as X
from loomgraph.grammars import interplay, penalty, requirement
from loomgraph.operators import evaluation as E
from loomgraph.operators import rules as R
from loomgraph.plans.registry import _CASE, _t
from loomgraph.sources.tables import dealt

_D = A.DIMENSIONS
URI, DATE = "urn:event", "2026-01-01"
INTERPLAY = {"ruleset_id": "r", "cues": [{"cue_id": "savings", "trigger_pattern": r"without prejudice to", "relation": "defers_to", "target_mode": "cited", "clause_end_chars": ".", "max_span_chars": 200, "confidence": 0.9}]}
PENALTY = {
    "ruleset_id": "p", "bound_type_phrases": [{"pattern": r"\bup to\b", "bound_type": "ceiling"}], "combination_phrases": [{"pattern": "whichever is higher", "combination_rule": "whichever_is_higher"}],
    "cues": [{"cue_id": "fine", "trigger_pattern": r"administrative fines", "penalty_kind": "administrative_fine", "expects_amount": True, "max_span_chars": 400, "confidence": 0.9}],
}


def _say(template: str) -> str:
    """A template over event_id (e), user_id (u) and small numbers derived from them, as an SQL expression that Spark and DuckDB share."""
    values = {"e": "event_id", "u": "user_id", "d": "(event_id % 30 + 1)", "n": "(event_id % 90 + 10)", "p": "(event_id % 9 + 1)", "y": "(2000 + event_id % 20)"}
    out, parts = [], template.split("{")
    for k, part in enumerate(parts):
        if k:
            name, _, part = part.partition("}")
            out.append(f"CAST({values[name]} AS VARCHAR(20))")
        if part:
            out.append("'" + part.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def _pick(by: str, templates: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {by} = {k} THEN {_say(t)}" for k, t in enumerate(templates)) + " END"


CLAUSE = "Where the controller fails, the processor shall, within {d} days, notify the data subject pursuant to Article {n}"
SENTENCES = ["Step {e} precedes step {u}.", "A unit {e} is part of the group {u}.", "Every user {u} cannot refuse event {e}.", "No record {e} is a claim.", "Event {e}."]
UNITS = ["The controller shall notify the supervisory authority within {d} days.", "Where user {u} objects, the processor shall not keep record {e}.", "‘Item {e}’ means the record of user {u}.", "User {u} is part of group {e}."]
LIST = "The authority shall: (a) keep record {e}; (b) inform user {u}; and (c) act at once."
SAID = ["Profiling of user {u} is allowed.", "The user {u} has no human review.", "A person reviews case {e}, and the user may contest the decision.", "Case {e}"]
SAVINGS = "This rule {e} applies without prejudice to Regulation (EU) {y}/{n}."
FINE = "Administrative fines up to {p} 000 000 EUR, or up to {p} % of the total worldwide annual turnover, whichever is higher, shall follow infringements of the following provisions: Articles 5, 6 and {n}."
HEADED = "CHAPTER II\n\nArticle {n}\n\ntext {e}\n\nSection {p}\n\nmore"


REFERRED = ["Article {n}(2) of this Regulation applies.", "The Data Act {y} applies, and section 4 of that Act binds user {u}.", "Articles {p} to 12 apply.", "Pursuant to Article {n} of Regulation (EU) {y}/{n}, point (b) applies."]


QUESTIONS = ["What is gear {e} for?", "why does user {u} stall", "How is it built, {e}", "when was {e} made", "Is {e} similar to {u}", "Steel {e} and tin", " what happened first {u} ", "reason so that {e} holds"]
NAMES = ["Part of {e}", "CAUSES {u}", "aims_at {e}", " precedes {e} ", "similar to {u}", "depends causally {e}", "shipped {e}", "then causes {u}"]


def _events(spark, sf_dir, text: str):
    return dealt(_t(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "user_id", F.expr(text.replace("VARCHAR(20)", "STRING")).alias("text"))


@F.arrow_udf(T.StructType([T.StructField(d, T.DoubleType()) for d in _D]))
def clause_contributions_of(text: pa.Array) -> pa.Array:
    once = text.dictionary_encode()  # a clause that a batch holds again is read once
    found = pa.array([{d: float(x) for d, x in C.contributions(t).items()} if t else dict.fromkeys(_D, 0.0) for t in [*once.dictionary.to_pylist(), None]], pa.struct([(d, pa.float64()) for d in _D]))
    return found.take(once.indices.fill_null(len(found) - 1))


def clause_contributions(spark, sf_dir):
    e = _events(spark, sf_dir, f"{_say(CLAUSE)} || CASE WHEN event_id % 3 = 0 THEN ' in order to ensure compliance.' ELSE '.' END")
    return e.withColumn("c", clause_contributions_of("text")).select("event_id", *(A.to_fixed(F.col(f"c.{d}")).alias(d) for d in _D))


def sentence_links(spark, sf_dir):
    e = _events(spark, sf_dir, _pick("event_id % 5", SENTENCES))
    return L.links(e, "text").select("event_id", "subject", "predicate", "object", "dimension", "negated", "quantification", "relation", "canonical", "converse")


def unit_outline(spark, sf_dir):
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "parent", "heir"))])))
    def nodes(text: pa.Array) -> pa.Array:
        return pa.array([outline.outline(t) if t else [] for t in text.to_pylist()], pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("start", "end", "parent", "heir"))])))

    return _events(spark, sf_dir, _say(LIST)).select("event_id", F.posexplode(nodes("text")).alias("node", "x")).select("event_id", "node", "x.*")


def unit_statements(spark, sf_dir):
    e = _events(spark, sf_dir, _pick("event_id % 4", UNITS)).withColumns({"uri": F.lit(URI), "date": F.lit(DATE)})
    return build.statements(e, "text", "uri", "date").select("event_id", "id", "subj", "obj", "predicate", "dimension", "layer", "start", "end", "negation", "extraction_rule_id")


def requirement_tags(spark, sf_dir):
    return requirement.tag(_events(spark, sf_dir, _pick("event_id % 4", SAID)), "text").select("event_id", "concept", "affirmed")


def requirement_obligations(spark, sf_dir):
    """Tags of texts to states of users to the obligations of a ruleset."""
    e = _events(spark, sf_dir, _pick("event_id % 4", SAID))
    rules = spark.createDataFrame([("contest", ["automated_decision_making"], ["human_intervention", "right_to_contest"])], "obligation_id string, trigger_concepts array<string>, required_concepts array<string>")
    found = R.check_requirements(e.select("user_id").distinct(), "user_id", R.concept_states(requirement.tag(e, "text"), "user_id"), rules)
    return found.select("user_id", "triggered", *(F.array_join(c, ",").alias(c) for c in ("present", "uncertain", "missing")), "all_present", "needs_review")


@F.arrow_udf(T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("kind", "instrument", "pinpoints")), T.StructField("start", T.IntegerType())])))
def referred(text: pa.Array, unit: pa.Array) -> pa.Array:
    out = []
    for found in references.resolved((t or "" for t in text.to_pylist()), unit.to_pylist()):
        out.append([{"kind": r["kind"], "instrument": r["external_instrument"], "pinpoints": ", ".join(x["pinpoint"] for x in r["targets"]) or r.get("external_target"), "start": r["literal_start"]} for r in found])
    return pa.array(out, pa.list_(pa.struct([*((n, pa.string()) for n in ("kind", "instrument", "pinpoints")), ("start", pa.int32())])))


def reference_resolver(spark, sf_dir):
    e = _events(spark, sf_dir, _pick("event_id % 4", REFERRED))
    return e.select("event_id", F.explode(referred("text", F.concat(F.lit("Article "), F.col("user_id").cast("string")))).alias("x")).select("event_id", "x.*")


def documents_references(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", F.explode(referred("text", F.lit(None).cast("string"))).alias("x")).select("doc_id", "x.*")


def interplay_relations(spark, sf_dir):
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("relation", T.StringType()), T.StructField("target", T.StringType()), T.StructField("start", T.IntegerType())])))
    def found(article: pa.Array, text: pa.Array) -> pa.Array:
        records = ([{"relation": r["relation"], "target": r["target_instrument"], "start": r["match_start"]} for r in interplay.relations([{"instrument_id": "own", "article_id": a, "text": t}], INTERPLAY)] for a, t in zip(article.to_pylist(), text.to_pylist(), strict=True))
        return pa.array(list(records), pa.list_(pa.struct([("relation", pa.string()), ("target", pa.string()), ("start", pa.int32())])))

    e = _events(spark, sf_dir, _say(SAVINGS))
    return e.select("event_id", F.explode(found(F.col("event_id").cast("string"), "text")).alias("x")).select("event_id", "x.*")


def penalty_triples(spark, sf_dir):
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("o", T.StringType()), T.StructField("euro", T.LongType()), T.StructField("percent", T.DoubleType()), *(T.StructField(n, T.StringType()) for n in ("basis", "bound", "combination"))])))
    def found(article: pa.Array, text: pa.Array) -> pa.Array:
        out, texts = [], text.to_pylist()
        read: dict[str, list] = {t: [] for t in texts}  # a text that a batch holds again is read once
        for k, t in enumerate(read):
            read[t] = [str(k), []]
        numbered = {k: found for k, found in read.values()}
        for r in penalty.penalties([{"instrument_id": "own", "article_id": k, "text": t} for t, (k, _) in read.items()], PENALTY):
            numbered[r["source_article"]].append(r)
        for a, t in zip(article.to_pylist(), texts, strict=True):
            triples = penalty.all_triples([r | {"source_article": a} for r in read[t][1]])
            out.append([{"s": x["s"], "o": x["o"], "euro": (p := x["provenance"])["fixed_amount_eur"], "percent": p["turnover_percentage"], "basis": p["turnover_basis"], "bound": p["bound_type"], "combination": p["combination_rule"]} for x in triples])
        return pa.array(out, pa.list_(pa.struct([("s", pa.string()), ("o", pa.string()), ("euro", pa.int64()), ("percent", pa.float64()), *((n, pa.string()) for n in ("basis", "bound", "combination"))])))

    e = _events(spark, sf_dir, _say(FINE))
    return e.select("event_id", F.explode(found(F.col("event_id").cast("string"), "text")).alias("x")).select("event_id", "x.*")


def text_enclosing_units(spark, sf_dir):
    @F.arrow_udf(T.StructType([T.StructField("unit", T.StringType()), T.StructField("chapter", T.StringType()), T.StructField("section", T.StringType())]))
    def units(text: pa.Array) -> pa.Array:
        rows = []
        for t in text.to_pylist():
            found = C.headings(t)
            rows.append({"unit": C.enclosing_unit(t, len(t), found=found)} | {"chapter": None, "section": None} | C.enclosing_units(t, len(t), found=found))
        return pa.array(rows, pa.struct([("unit", pa.string()), ("chapter", pa.string()), ("section", pa.string())]))

    return _events(spark, sf_dir, _say(HEADED)).select("event_id", units("text").alias("x")).select("event_id", "x.*")


def document_violations(spark, sf_dir):
    """Documents of four kinds as JSON, one for each event, sound or not by its value."""
    e = _t(spark, sf_dir, "events").withColumn("bad", F.col("value") > 100)
    s = F.struct(F.lit("u#d#0123456789abcdef").alias("id"), F.lit("s").alias("subj"), F.lit("o").alias("obj"), F.lit("is_a").alias("predicate"), F.when(F.col("bad"), "causal").otherwise("structural").alias("dimension"), F.lit("deep").alias("layer"), F.lit(0.5).alias("edge_confidence"), F.struct(F.lit(3).alias("start"), F.when(F.col("bad"), 3).otherwise(4).alias("end")).alias("provenance"), F.lit("absent").alias("negation"))
    v = F.struct(F.lit(1).alias("value"), F.lit("position").alias("kind"), F.lit("x").alias("position_digest"), F.lit("b").alias("basis"), F.col("bad").alias("stale"), F.lit(None).cast("string").alias("staleness_tier"))
    axis = F.struct(F.when(F.col("bad"), "closed").otherwise("open").alias("vocabulary_mode"))
    n = F.struct(F.lit("sys").alias("id"), F.lit("org.example").alias("namespace"), F.lit("1").alias("version"), F.struct(axis.alias("a")).alias("axes"))
    p = F.struct(*(F.when(F.col("bad") & (F.lit(d) == "causal"), 1.5).otherwise(0.5).alias(d) for d in _D))
    kind = F.element_at(F.array(*map(F.lit, ("statement", "view", "nd_system", "point"))), (F.col("event_id") % 4 + 1).cast("int"))
    doc = F.when(F.col("event_id") % 4 == 0, F.to_json(s)).when(F.col("event_id") % 4 == 1, F.to_json(v)).when(F.col("event_id") % 4 == 2, F.to_json(n)).otherwise(F.to_json(p))
    found = e.select("event_id", kind.alias("kind"), D.checked(kind, doc).alias("v"))
    return found.select("event_id", "kind", F.array_join(F.transform("v", lambda x: F.concat_ws(": ", x["path"], x["message"])), "; ").alias("violations"))


def replay_decided(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("candidate_set_sha"))
    sets = replay.keyed(e, "view", "model", "prompt")
    return replay.decided(sets, sets.where("event_id % 3 <> 0").select("key", F.lit("{}").alias("decision"))).select("event_id", "key", "status")


def _customer_links(spark, sf_dir):
    n = _t(spark, sf_dir, "customer").agg(F.count("*").alias("n"))  # one row
    o = _t(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n")).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("dimension"))


def evaluation_citation_signals(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    pairs = c.select(F.col("c_custkey").alias("a")).join(c.select(F.col("c_custkey").alias("b")), F.col("b") == F.col("a") + 1)
    return E.citation_signals(_customer_links(spark, sf_dir), pairs)


def evaluation_rarity_overlap(spark, sf_dir):
    l, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderkey").alias("a")).join(o.select(F.col("o_orderkey").alias("b")), F.col("b") == F.col("a") + 1)
    return E.rarity_overlap(l, pairs, "l_orderkey", "l_suppkey")


def evaluation_signatures(spark, sf_dir):
    return E.two_hop_signatures(_customer_links(spark, sf_dir).selectExpr("cast(src as string) src", "cast(dst as string) dst", "dimension")).groupBy("node").agg(F.count("*").alias("elements"))


def evaluation_span_scores(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    found = e.select("user_id", (F.col("event_id") * 3).alias("start"), (F.col("event_id") * 3 + F.floor(F.col("value") / 4) + 1).alias("end"))
    gold = e.where("event_type <> 'error'").select("user_id", (F.col("event_id") * 3 + 2).alias("start"), (F.col("event_id") * 3 + 22).alias("end"))
    return E.span_scores(found, gold, "user_id")


def _documents(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # texts may be of any length
    return dealt(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def dim_classify_query(spark, sf_dir):
    return _events(spark, sf_dir, _pick("event_id % 8", QUESTIONS)).select("event_id", X.classify_query(F.col("text")).alias("dimension"))


def dim_classify_predicate(spark, sf_dir):
    return _events(spark, sf_dir, _pick("event_id % 8", NAMES)).select("event_id", X.classify_predicate(F.col("text")).alias("dimension"))


def path_fold_statements(spark, sf_dir):
    """Paths of eight events each, in order."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 8).alias("run"), F.expr(_CASE).alias("dimension"), ((F.col("event_id") % 10 + 90) / F.lit(100.0)).alias("weight"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "dimension", "weight"))), lambda x: F.struct(x["dimension"].alias("dimension"), x["weight"].alias("weight")))
    return e.groupBy("run").agg(path.alias("p")).withColumn("f", A.fold_path(F.col("p"))).select("run", "f.dimension", "f.weight")


def dim_classify_documents(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", X.classify_query(F.col("text")).alias("question"), X.classify_predicate(F.col("text")).alias("predicate"))


def documents_statements(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("unit"), F.lit(URI).alias("uri"), F.lit(DATE).alias("date"))
    return build.statements(d, "unit", "uri", "date").drop("unit", "uri", "date")


def documents_concepts(spark, sf_dir):
    return requirement.tag(_documents(spark, sf_dir), "text").select("doc_id", "concept", "affirmed")


_NUMBERS = "d AS (SELECT event_id AS e, user_id AS u, event_id % 30 + 1 AS d, event_id % 90 + 10 AS n, event_id % 9 + 1 AS p, 2000 + event_id % 20 AS y, value FROM events)"
_ID = "'" + URI + "#" + DATE + "#' || substr(sha256(predicate || '|' || subj || '|' || obj || '|' || \"start\" || '-' || \"end\"), 1, 16)"
_LINKS = "(SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst, substr(o_orderpriority, 1, 1) AS dimension FROM orders)"
_len = lambda x: f"length({x}::VARCHAR)"


def _cases(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _first_of(text, table, other):
    return "CASE " + " ".join(f"WHEN len(list_filter({_cases(words)}, lambda w: contains({text}, w))) > 0 THEN '{d}'" for d, words in table.items()) + f" {other} END"


ORACLES = {
    "clause_contributions": f"WITH {_NUMBERS} SELECT e AS event_id, 2000000::BIGINT AS structural, 1000000::BIGINT AS causal, (CASE WHEN e % 3 = 0 THEN 1000000 ELSE 0 END)::BIGINT AS intentional, 1000000::BIGINT AS temporal, (CASE WHEN e % 3 = 0 THEN 500000 ELSE 600000 END)::BIGINT AS relational FROM d",
    "sentence_links": f"""WITH {_NUMBERS} SELECT e AS event_id, ['Step ' || e, 'unit ' || e, 'user ' || u, 'record ' || e][e % 5 + 1] AS subject, ['precedes', 'part of', 'refuse', 'is'][e % 5 + 1] AS predicate, ['step ' || u, 'group ' || u, 'event ' || e, 'claim'][e % 5 + 1] AS object,
        ['temporal', 'structural', 'relational', 'structural'][e % 5 + 1] AS dimension, e % 5 >= 2 AS negated, ['existential', 'existential', 'universal', 'empty'][e % 5 + 1] AS quantification, ['precedes', 'part-of', 'predication', 'is-a'][e % 5 + 1] AS relation,
        CASE WHEN e % 5 = 0 THEN 'precedes' END AS canonical, CASE WHEN e % 5 = 0 THEN false END AS converse FROM d WHERE e % 5 < 4""",
    "unit_outline": f"""WITH {_NUMBERS}, x AS (SELECT e, 36 + {_len('e')} + 1 AS a, 36 + {_len('e')} AS z1, u FROM d),
        n AS (SELECT e, 25 AS s1, 25 + 12 + {_len('e')} AS e1, 25 + 12 + {_len('e')} + 6 AS s2, 25 + 12 + {_len('e')} + 6 + 12 + {_len('u')} AS e2, 25 + 12 + {_len('e')} + 6 + 12 + {_len('u')} + 10 AS s3 FROM d)
        SELECT e AS event_id, unnest([0, 1, 2, 3, 4]) AS node, unnest(['sentence', 'chapeau', 'list_item', 'list_item', 'list_item']) AS kind, unnest([0, 0, s1, s2, s3])::INTEGER AS "start", unnest([s3 + 11, 19, e1, e2, s3 + 11])::INTEGER AS "end",
            unnest([NULL, 0, 1, 1, 1])::INTEGER AS parent, unnest([NULL, NULL, 1, 1, 1])::INTEGER AS heir FROM n""",
    "unit_statements": f"""WITH {_NUMBERS}, s AS (
        SELECT e, 'notify' AS subj, 'supervisory_authority' AS obj, 'addressed_to' AS predicate, 'relational' AS dimension, 'domain' AS layer, 21 AS "start", 61 + length(d || ' days') AS "end", 'T3-addressed_to-verb-direct-recipient' AS rule FROM d WHERE e % 4 = 0
        UNION ALL SELECT e, 'notify', d || ' days', 'deadline_of', 'temporal', 'domain', 0, 61 + length(d || ' days'), 'T3-deadline_of-within-n' FROM d WHERE e % 4 = 0
        UNION ALL SELECT e, 'user ' || u || ' objects', 'not keep record ' || e, 'requires', 'causal', 'domain', 0, length('Where user ' || u || ' objects, the processor shall not keep record ' || e), 'T3-requires-where-if' FROM d WHERE e % 4 = 1
        UNION ALL SELECT e, 'Item ' || e, 'record of user ' || u, 'is_a', 'structural', 'deep', 0, length('‘Item ' || e || '’ means the record of user ' || u), 'T3-is_a-quoted-means' FROM d WHERE e % 4 = 2
        UNION ALL SELECT e, 'User ' || u, 'group ' || e, 'part_of', 'structural', 'domain', 0, length('User ' || u || ' is part of group ' || e), 'T3-part_of-is-part-of' FROM d WHERE e % 4 = 3)
        SELECT e AS event_id, {_ID} AS id, subj, obj, predicate, dimension, layer, "start"::INTEGER AS "start", "end"::INTEGER AS "end", 'absent' AS negation, rule AS extraction_rule_id FROM s""",
    "requirement_tags": "SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['automated_decision_making'] WHEN 1 THEN ['human_intervention'] WHEN 2 THEN ['human_intervention', 'right_to_contest'] ELSE [] END) AS concept, event_id % 4 <> 1 AS affirmed FROM events",
    "requirement_obligations": """WITH s AS (SELECT user_id, bool_or(event_id % 4 = 0) AS auto, bool_or(event_id % 4 = 1) AS maybe, bool_or(event_id % 4 = 2) AS yes FROM events GROUP BY user_id)
        SELECT user_id, auto AS triggered, CASE WHEN yes THEN 'human_intervention,right_to_contest' ELSE '' END AS present, CASE WHEN NOT yes AND maybe THEN 'human_intervention' ELSE '' END AS uncertain,
            CASE WHEN yes THEN '' WHEN maybe THEN 'right_to_contest' ELSE 'human_intervention,right_to_contest' END AS missing, CASE WHEN auto THEN yes END AS all_present, NOT yes AND maybe AS needs_review FROM s""",
    "reference_resolver": f"""WITH {_NUMBERS} SELECT e AS event_id, 'INTERNAL' AS kind, NULL AS instrument, 'Article ' || n || '(2)' AS pinpoints, 0 AS "start" FROM d WHERE e % 4 = 0
        UNION ALL SELECT e, 'EXTERNAL', 'The Data Act ' || y, NULL, 0 FROM d WHERE e % 4 = 1 UNION ALL SELECT e, 'EXTERNAL', 'The Data Act ' || y, 'section 4', 31 FROM d WHERE e % 4 = 1
        UNION ALL SELECT e, 'INTERNAL', NULL, array_to_string(list_transform(range(p, 13), lambda k: 'Article ' || k), ', '), 0 FROM d WHERE e % 4 = 2
        UNION ALL SELECT e, 'EXTERNAL', 'Regulation (EU) ' || y || '/' || n, 'Article ' || n, 12 FROM d WHERE e % 4 = 3 UNION ALL SELECT e, 'INTERNAL', NULL, 'Article ' || u || ', point (b)', 51 FROM d WHERE e % 4 = 3""",
    "interplay_relations": f"WITH {_NUMBERS} SELECT e AS event_id, 'defers_to' AS relation, 'external:regulation-eu-' || y || '-' || n AS target, (length('This rule ' || e || ' applies '))::INTEGER AS \"start\" FROM d",
    "penalty_triples": f"""WITH {_NUMBERS} SELECT DISTINCT e AS event_id, 'own:Art.' || unnest([5, 6, n]) AS s, e || ':administrative_fine' AS o, p::BIGINT * 1000000 AS euro, p::DOUBLE AS percent, 'total worldwide annual turnover' AS basis, 'ceiling' AS bound, 'whichever_is_higher' AS combination FROM d""",
    "text_enclosing_units": f"WITH {_NUMBERS} SELECT e AS event_id, 'Article ' || n AS unit, 'Chapter II' AS chapter, 'Section ' || p AS section FROM d",
    "document_violations": """SELECT event_id, ['statement', 'view', 'nd_system', 'point'][event_id % 4 + 1] AS kind, CASE WHEN value > 100 THEN [
        'dimension: not the predicate''s dimension; provenance: the span is empty', 'staleness_tier: a stale view has a tier', 'axes.a.vocabulary: a closed vocabulary has values', 'causal: not within 0 and 1'][event_id % 4 + 1] ELSE '' END AS violations FROM events""",
    "replay_decided": "SELECT event_id, sha256(sha256(event_id::VARCHAR) || '|view|model|prompt') AS key, CASE WHEN event_id % 3 <> 0 THEN 'replayed' ELSE 'missed' END AS status FROM events",
    "evaluation_citation_signals": f"""WITH e AS (SELECT DISTINCT src, dst FROM {_LINKS}), p AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1),
        c AS (SELECT a, count(*) AS n FROM p JOIN e x ON x.dst = a JOIN e y ON y.dst = b AND y.src = x.src GROUP BY a), k AS (SELECT a, count(*) AS n FROM p JOIN e x ON x.src = a JOIN e y ON y.src = b AND y.dst = x.dst GROUP BY a),
        t AS (SELECT a, count(*) AS n FROM p JOIN e ON (src = a AND dst = b) OR (src = b AND dst = a) GROUP BY a)
        SELECT p.a, p.b, coalesce(t.n, 0) AS direct, coalesce(c.n, 0) AS cocitation, coalesce(k.n, 0) AS coupling FROM p LEFT JOIN t USING (a) LEFT JOIN c USING (a) LEFT JOIN k USING (a)""",
    "evaluation_rarity_overlap": """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS e FROM lineitem), w AS (SELECT e, round(1000000000000::DOUBLE / count(*))::BIGINT AS w FROM s GROUP BY e), x AS (SELECT k, e, w FROM s JOIN w USING (e)), t AS (SELECT k, sum(w)::BIGINT AS t FROM x GROUP BY k),
        p AS (SELECT m.o_orderkey AS a, n.o_orderkey AS b FROM orders m JOIN orders n ON n.o_orderkey = m.o_orderkey + 1), c AS (SELECT a, sum(x.w)::BIGINT AS c FROM p JOIN x ON x.k = a JOIN s y ON y.k = b AND y.e = x.e GROUP BY a)
        SELECT a, b, (CASE WHEN coalesce(m.t, 0) + coalesce(n.t, 0) - coalesce(c, 0) > 0 THEN coalesce(c, 0)::HUGEINT * 1000000 // (coalesce(m.t, 0) + coalesce(n.t, 0) - coalesce(c, 0)) ELSE 0 END)::BIGINT AS overlap FROM p LEFT JOIN t m ON m.k = a LEFT JOIN t n ON n.k = b LEFT JOIN c USING (a)""",
    "evaluation_signatures": f"""WITH e AS (SELECT DISTINCT src::VARCHAR AS src, dst::VARCHAR AS dst, dimension FROM {_LINKS}), s AS (SELECT src AS node, dimension || '|' || dst AS element FROM e UNION SELECT x.src, x.dimension || '|' || x.dst || '|' || y.dimension || '|' || y.dst FROM e x JOIN e y ON x.dst = y.src)
        SELECT node, count(*) AS elements FROM s GROUP BY node""",
    "dim_classify_query": rf"""SELECT event_id, CASE WHEN regexp_matches(q, '\bwhat\b.{{0,40}}\bfor\b\s*\??\s*$|for what purpose') THEN 'intentional' ELSE {_first_of("(' ' || q || ' ')", X.QUERY_CUES, "")} END AS dimension FROM (SELECT event_id, trim(lower({_pick("event_id % 8", QUESTIONS)})) AS q FROM events)""",
    "dim_classify_predicate": f"""SELECT event_id, {_first_of("translate(q, ' _', '--')", X.KEYWORDS, "ELSE 'relational'")} AS dimension FROM (SELECT event_id, trim(lower({_pick("event_id % 8", NAMES)})) AS q FROM events)""",
    "path_fold_statements": f"""WITH p AS (SELECT event_id // 8 AS run, list({_CASE} ORDER BY event_id) AS d, list((event_id % 10 + 90) / 100.0::DOUBLE ORDER BY event_id) AS w FROM events GROUP BY 1)
        SELECT run, list_reduce(list_prepend('relational', d), lambda a, b: CASE WHEN b = 'relational' THEN a WHEN a = 'causal' AND b = 'structural' THEN 'causal' ELSE b END) AS dimension, list_reduce(list_prepend(1.0::DOUBLE, w), lambda a, b: a * b) AS weight FROM p""",
    "dim_classify_documents": rf"""WITH d AS (SELECT doc_id, trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13)) AS q FROM documents)
        SELECT doc_id, CASE WHEN q IS NULL THEN NULL WHEN regexp_matches(q, '\bwhat\b.{{0,40}}\bfor\b\s*\??\s*$|for what purpose') THEN 'intentional' ELSE {_first_of("(' ' || q || ' ')", X.QUERY_CUES, "")} END AS question, {_first_of("translate(coalesce(q, ''), ' _', '--')", X.KEYWORDS, "ELSE 'relational'")} AS predicate FROM d""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
#: SQL can't match spans greedily or parse units: tested against plain versions.
WITHOUT_SQL = {"evaluation_span_scores": evaluation_span_scores, "documents_statements": documents_statements, "documents_concepts": documents_concepts, "documents_references": documents_references}
