"""Cue classification, terms, statement vocabulary, references and violations, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions import algebra as A

#: Keywords of predicates, by dimension in order of precedence (underscores read as hyphens).
KEYWORDS = {
    "structural": ["part-of", "contains", "component", "depends-on", "has-part", "belongs-to", "composed-of", "subclass", "instance-of", "member-of"],
    "causal": ["causes", "cause", "triggers", "trigger", "enables", "enable", "prevents", "prevent", "leads-to", "results-in", "produces", "requires", "depends-causally", "blocks"],
    "intentional": ["aims-at", "justifies", "justify", "motivates", "motivate", "intended-for", "purpose", "goal", "in-order-to", "so-that", "serves", "objective"],
    "temporal": ["before", "after", "during", "succeeds", "precedes", "follows", "then", "next", "while", "since", "until", "expires", "starts", "ends", "scheduled"],
}
#: Cues of questions, by dimension in order of precedence.
QUERY_CUES = {
    "intentional": ["what is it for", "what's it for", "what is this for", "purpose of", "the purpose", "in order to", "so that", "intended to", "goal of", "objective", "what is the point", "meant to"],
    "causal": ["why", "because", "what causes", "cause of", "causes", "reason", "leads to", "result of", "due to", "what makes", "what triggers"],
    "structural": ["how is", "how does it work", "structure of", "made of", "part of", "parts of", "component", "depends on", "built", "composed of", "consists of", "made up of"],
    "temporal": ["when", "timeline", "sequence", "in what order", "order of", "before", "after", "history of", "evolution of", "what happened first"],
    "relational": ["similar to", "related to", "compare", "comparison", "associated", "connection between", "relationship between", "like "],
}
#: Fixed value: a question for a purpose, whatever stands in its middle.
PURPOSE = r"\bwhat\b.{0,40}\bfor\b\s*\??\s*$|for what purpose"
#: Words that are no terms.
STOPWORDS = ["the", "of", "to", "in", "and", "or", "a", "an", "for", "by", "with", "is", "are", "shall", "be", "this", "that", "which", "as", "on", "at", "it", "its", "their", "has", "have", "not", "such", "any", "other", "where", "who", "may", "if"]
#: The dimension of each predicate.
PREDICATES = {
    "is_a": "structural", "part_of": "structural", "applies_to": "structural", "cross_references": "structural", "except_when": "structural", "enables": "causal", "requires": "causal",
    "legislative_purpose_of": "intentional", "compliance_purpose_of": "intentional", "based_on": "intentional", "precedes": "temporal", "deadline_of": "temporal",
    "predication": "relational", "competence_of": "relational", "performs": "relational", "addressed_to": "relational",
}
#: Roles of actors; besides them, other(label).
ACTORS = [
    "controller", "joint_controller", "processor", "sub_processor", "provider", "deployer", "importer", "distributor", "authorised_representative", "data_subject",
    "data_protection_officer", "supervisory_authority", "notified_body", "market_surveillance_authority", "commission", "member_state", "european_data_protection_board", "ai_office",
    "third_party", "recipient", "operator", "competent_authority", "digital_services_coordinator", "csirt", "essential_entity", "important_entity", "provider_of_online_platform",
    "very_large_online_platform",
]
LAYERS = ["surface", "domain", "deep"]


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def classify_predicate(c: Column) -> Column:
    """The first dimension with a keyword in the name; relational without one."""
    name = F.translate(_stripped(F.lower(F.coalesce(c, F.lit("")))), " _", "--")
    return F.coalesce(*(F.when(_any(name, words), d) for d, words in KEYWORDS.items()), F.lit("relational"))


def classify_query(c: Column) -> Column:
    """The dimension that a question leans to: purpose first, then cues in order; NULL without any."""
    bare = _stripped(F.lower(c))
    padded = F.concat(F.lit(" "), bare, F.lit(" "))
    return F.coalesce(F.when(bare.rlike(PURPOSE), "intentional"), *(F.when(_any(padded, cues), d) for d, cues in QUERY_CUES.items()))


def terms(c: Column) -> Column:
    """Lower-case runs of two ASCII letters or more that are no stop words, in order, repeats included."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z]{2,}"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def predicate_dimension(c: Column) -> Column:
    """NULL for an unknown predicate."""
    return F.coalesce(*(F.when(c.isin([p for p, of in PREDICATES.items() if of == d]), d) for d in A.DIMENSIONS))


def is_known_actor(c: Column) -> Column:
    return F.coalesce(c.isin(ACTORS) | c.rlike(r"^other\([^()]+\)$"), F.lit(False))


def text_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """In composed form (NFC). There is no such function in the JVM's catalogue."""
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def statement_id(uri: Column, date: Column, text: Column) -> Column:
    """uri#date#hash of the text with white space collapsed; NULL where a part holds a #."""
    bare = F.trim(F.regexp_replace(composed(text), r"[\u00A0 \t\n\r\f\x0B]+", " "))
    return F.when(~F.contains(uri, F.lit("#")) & ~F.contains(date, F.lit("#")), F.concat_ws("#", uri, date, text_hash(bare)))


def layered() -> list[Column]:
    """Aggregates over rows (dim, layer): a count for each of the three layers and five dimensions, named layer_dimension."""
    return [F.count(F.when((F.col("layer") == layer) & (F.col("dim") == d), 1)).alias(f"{layer}_{d}") for layer in LAYERS for d in A.DIMENSIONS]


def reference(c: Column, scheme: str) -> Column:
    """A span reference in its canonical form urn#start-end, from that form or the older scheme://path#span-start-end and urn#unit:start-end; NULL for what is none or has its end before its start."""
    shapes = [rf"^({scheme}://.+)#span-()(\d+)-(\d+)$", r"^(.+)#([^:#]+):(\d+)-(\d+)$", r"^(.+)#()(\d+)-(\d+)$"]
    part = lambda i: F.coalesce(*(F.when(c.rlike(p), F.regexp_extract(c, p, i)) for p in shapes))
    digits = lambda i: F.regexp_replace(part(i), "^0+(?=.)", "")
    start, end = digits(3), digits(4)
    ordered = (F.length(start) < F.length(end)) | ((F.length(start) == F.length(end)) & (start <= end))
    return F.when(ordered, F.concat(part(1), F.lit("#"), start, F.lit("-"), end))


def content_digest(ref: Column, text: Column, domain: str) -> Column:
    """SHA-256 over a domain with a zero byte, the length of the reference in eight bytes, the reference and the text."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(ref).cast("long")), 16, "0"))
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), length, ref.cast("binary"), text.cast("binary")), 256)


def _said(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(wrong, message) for wrong, message in checks)))


def triple_violations(s: Column, p: Column, o: Column, dimension: Column, weight: Column) -> Column:
    """What is wrong with a triple, one message each; empty if nothing is. A missing weight is one."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    absent = empty(dimension)
    w = F.coalesce(weight, F.lit(1.0))
    return _said((empty(s), "s is empty"), (empty(p), "p is empty"), (empty(o), "o is empty"), (absent, "no dimension"), (~absent & ~A.is_dimension(dimension), "unknown dimension"), ((w < 0) | (w > 1) | F.isnan(w), "weight out of range"))


def link_violations(relation: Column, dimension: Column) -> Column:
    """A link has one dimension and a relation; one that embeds is structural."""
    absent, unnamed = F.coalesce(dimension == "", F.lit(True)), F.coalesce(relation == "", F.lit(True))
    embeds = ~unnamed & (A.relation_key(relation) == "embeds")
    return _said((absent, "no dimension"), (~absent & ~A.is_dimension(dimension), "unknown dimension"), (unnamed, "no relation"), (embeds & ~dimension.eqNullSafe(F.lit("structural")), "embeds is structural"))
