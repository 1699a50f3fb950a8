"""The engine in SQL: functions and table functions registered on a session, and planes that bring their own claims.

`register(spark)` makes the text functions callable from Spark SQL. A plane is a descriptor in its runtime form, whose `produce(sentence, context)` gives triples; `register_plane` checks the descriptor and registers a table function
of its own. Other readings of negation are registered under a version (extract.build.register_negation), rulesets are passed as data.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import documents as D
from loomgraph.extract import build, outline
from loomgraph.functions import citations, lowering
from loomgraph.grammars import interplay, penalty, requirement


class ExtractStatements:
    """extract_statements(text, uri, date, provision): the statements of a unit."""

    def eval(self, text: str, uri: str, date: str, where: str | None) -> Iterator[tuple]:
        for s in build.extract(text, uri=uri, date=date, where=where) if text and uri and date else ():
            yield tuple(build.flat(s).values())


class Outline:
    """outline(text): kind, start, end, parent, heir of each node."""

    def eval(self, text: str) -> Iterator[tuple]:
        for d in outline.outline(text) if text else ():
            yield d["kind"], d["start"], d["end"], d["parent"], d["heir"]


class Headings:
    """headings(text, family): place, level and name of each heading."""

    def eval(self, text: str, family: str) -> Iterator[tuple]:
        yield from citations.headings(text or "", family)


class InstrumentCitations:
    """instrument_citations(text): start, end, instrument, words."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from interplay.citations(text or "")


class Relations:
    """interplay_relations(instrument, article, text, ruleset as JSON): relation, target and confidence of each record."""

    def eval(self, instrument: str, article: str, text: str, ruleset: str) -> Iterator[tuple]:
        for r in interplay.relations([{"instrument_id": instrument, "article_id": article, "text": text or ""}], json.loads(ruleset)):
            yield r["cue_id"], r["relation"], r["target_instrument"], r["target_article"], r["unresolved"], r["confidence"], r["match_start"]


class Penalties:
    """penalties(instrument, article, text, ruleset as JSON): what each penalty is and follows."""

    def eval(self, instrument: str, article: str, text: str, ruleset: str) -> Iterator[tuple]:
        for r in penalty.penalties([{"instrument_id": instrument, "article_id": article, "text": text or ""}], json.loads(ruleset)):
            yield r["cue_id"], r["penalty_kind"], r["fixed_amount_eur"], r["turnover_percentage"], r["turnover_basis"], r["bound_type"], r["combination_rule"], r["addressee"], r["infringed_provisions"], r["unresolved"], r["match_start"]


_STATEMENT = "id string, subj string, obj string, predicate string, dimension string, layer string, weight double, edge_confidence double, negation string, extraction_rule_id string, `start` int, `end` int"
TABLE_FUNCTIONS = {
    "extract_statements": (ExtractStatements, _STATEMENT), "outline": (Outline, "kind string, `start` int, `end` int, parent int, heir int"), "headings": (Headings, "place int, level string, name string"),
    "instrument_citations": (InstrumentCitations, "`start` int, `end` int, instrument string, words string"),
    "interplay_relations": (Relations, "cue_id string, relation string, target_instrument string, target_article string, unresolved boolean, confidence double, match_start int"),
    "penalties": (Penalties, "cue_id string, penalty_kind string, fixed_amount_eur bigint, turnover_percentage double, turnover_basis string, bound_type string, combination_rule string, addressee string, infringed_provisions array<string>, unresolved boolean, match_start int"),
}
#: Catalyst expressions as SQL functions: they are inlined into the query's plan.
SQL_FUNCTIONS = {
    "is_dimension(d STRING) RETURNS BOOLEAN": "coalesce(d IN ('structural', 'causal', 'intentional', 'temporal', 'relational'), false)",
    "dim_compose(a STRING, b STRING) RETURNS STRING": "CASE WHEN a IN ('structural', 'causal', 'intentional', 'temporal', 'relational') AND b IN ('structural', 'causal', 'intentional', 'temporal', 'relational') THEN CASE WHEN b = 'relational' OR (a = 'causal' AND b = 'structural') THEN a ELSE b END END",
    "to_fixed(x DOUBLE) RETURNS BIGINT": "CASE WHEN x >= 0 THEN cast(x * 1e6D + 0.5D AS BIGINT) ELSE -cast(-x * 1e6D + 0.5D AS BIGINT) END",
    "from_fixed(n BIGINT) RETURNS DOUBLE": "n / 1e6D",
    "relation_key(k STRING) RETURNS STRING": r"regexp_replace(lower(coalesce(k, '')), '(?U)[\\s_-]+', '')",
    "tiebreak_key(id STRING, salt STRING) RETURNS STRING": "sha2(concat(salt, '|', id), 256)",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    scalars = {"lower_assertion": lowering.lowered, "extract_array": build.extracted, "tag_concepts": requirement.concepts, "document_violations": D._checked}
    for name, f in scalars.items():
        spark.udf.register(name, f)
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
    return [s.split("(")[0] for s in SQL_FUNCTIONS] + [*scalars, *TABLE_FUNCTIONS]


TRIPLE = "s string, p string, o string, dimension string, weight double"


def register_plane(spark: SparkSession, descriptor: dict) -> str:
    """Registers <plane>_claims(sentence, context as JSON), which gives the triples that the plane's produce() gives; those that are malformed, or not in the dimension that their relation is bound to, are errors."""
    wrong = D.violations("descriptor", descriptor, runtime=True)
    if wrong:
        raise ValueError("; ".join(wrong))
    produce: Callable = descriptor["produce"]
    binding = dict(descriptor["binding"])

    class Claims:
        def eval(self, sentence: str, context: str | None) -> Iterator[tuple]:
            for t in produce(sentence, json.loads(context) if context else {}):
                bad = D.violations("triple", {"provenance": None} | t)
                if bad or binding.get(t["p"], t["dimension"]) != t["dimension"]:
                    raise ValueError("; ".join(bad) or f"{t['p']} is bound to {binding[t['p']]}")
                yield t["s"], t["p"], t["o"], t["dimension"], float(t.get("weight", 1.0))

    name = descriptor["plane"].replace("-", "_").replace(".", "_") + "_claims"
    spark.udtf.register(name, F.udtf(Claims, returnType=TRIPLE))
    return name


def timed(call: Callable, *args, **options) -> tuple:
    """The result of a call and its seconds, apart, so that no time gets into what is hashed."""
    began = time.perf_counter()
    return call(*args, **options), time.perf_counter() - began
