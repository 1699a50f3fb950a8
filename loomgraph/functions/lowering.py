"""A sentence to one link: subject, predicate, object, dimension, negation, quantification. Nothing is guessed: without a cue, a verb, a subject or an object there is no link."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The relations with their dimensions, and the cues of copulas, orders, modals and what surrounds them.
BINDING = {"is-a": "structural", "part-of": "structural", "has-part": "structural", "precedes": "temporal", "follows": "temporal", "predication": "relational"}
QUANTIFIERS = ["universal", "existential", "empty"]
_i = lambda p: re.compile(p, re.I)
_COPULA = _i(r"\b(?:is|are|shall be|means|include[sd]?|consists? of|refers? to)\b")
_KINDS = {
    "is-a": _i(r"\b(?:is|are|shall be)\s+(?:not\s+)?(?:a|an|one of(?: the)?|a type of|a kind of|a category of)\b"), "part-of": _i(r"\b(?:is|are|shall be)\s+(?:not\s+)?(part of)\b"),
    "has-part": _i(r"\b(?:is|are|shall be)\s+(?:not\s+)?(comprised of|composed of)\b"),
}
_ORDERS = {"precedes": _i(r"\b(?:precedes?|comes? before|takes? place before|is followed by|are followed by)\b"), "follows": _i(r"\b(?:follows?|comes? after|takes? place after|succeeds?)\b")}
_MODAL = _i(r"\b(?:must|shall|should|may|can|could|might|will|would|(?:is|are) required to|(?:has|have) to|ought to)(?:\s+|(?<=can)(?=not\s))(not\s+)?(?=[a-z])")
_THEN = _i(r"\s+(?:before|prior to|until|after|once|following)\s+")
_THAT = _i(r"\b(?:knows?|believes?|is aware|are aware|becomes? aware|considers?|finds?|states?|establishe[sd]|holds?|is satisfied|are satisfied)\s+that\s+")
_NOT, _ALL, _NONE = _i(r"\b(?:not|no|never|neither|without)\b"), _i(r"\b(?:all|any|every|each)\b"), _i(r"\b(?:no|none of|neither)\b")
_LABELS = _i(r"^(?:[-–—•*]\s*|\(\s*[0-9a-z]{1,3}\s*\)\s*|[0-9]+(?:\.[0-9]+)*\.?\s+)+")
_LEAD = _i(r"^(?:a|an|the|its|their|any|this|each|every|all|both|such|no|der|die|das|ein|eine|jede[rs]?)\s+")
_TRAIL = _i(r"\s+(?:which\b|who\b|whose\b|to which\b|as referred to\b|referred to in\b|pursuant to\b|adopted by\b|involved in\b|of the (?:main|seconding)\b).*$")
_OBJECT_LEAD = _i(r"^(?:not\s+)?(?:a|an|the|one of(?: the)?|part of)\s+")
_EDGES = " .,;:"


def entity(raw: str) -> str:
    """The thing that a stretch before a cue names: without labels, what stands before its last comma, a determiner and a tail."""
    s = _LABELS.sub("", raw.strip()).strip().rsplit(",", 1)[-1].strip()
    return _TRAIL.sub("", _LEAD.sub("", s).strip()).strip().strip(_EDGES)


def _target(raw: str) -> str:
    return _OBJECT_LEAD.sub("", raw.strip()).strip(_EDGES)


def quantification(subject: str) -> str:
    return "empty" if _NONE.search(subject) else "universal" if _ALL.search(subject) else "existential"


def _copula(text: str, m: re.Match) -> tuple:
    after = text[m.end() :].strip()
    relation, kind = next(((r, k) for r, p in _KINDS.items() if (k := p.search(text))), ("predication", None))
    named = kind is not None and kind.re.groups > 0
    predicate, rest = (kind[1], _OBJECT_LEAD.sub("", text[kind.end() :].strip())) if named else (m[0].strip(), after)
    return relation, predicate, _target(rest), bool(_NOT.search(after[:24])), None


def _order(relation: str):
    return lambda text, m: (relation, m[0].strip(), _target(text[m.end() :]), False, ("precedes", relation == "follows"))


def _modal(text: str, m: re.Match) -> tuple | None:
    verb = re.compile(r"\s*([A-Za-z][A-Za-z-]*)").match(text, m.end())
    if not verb:
        return None
    stop = _THEN.search(text, verb.end())
    return "predication", verb[1], _target(text[verb.end() : stop.start() if stop else None]), bool(m[1]), None


#: Readings by how they are preferred where cues begin together and are equally long: orders, the copula, modals.
_READINGS = [(p, _order(r)) for r, p in _ORDERS.items()] + [(_COPULA, _copula), (_MODAL, _modal)]


def lower(sentence: str) -> dict | None:
    """The link of a sentence, or None. Of a sentence that somebody knows, finds or states, only what follows `that` is read; the earliest cue decides, and of several there the longest."""
    if not isinstance(sentence, str) or not sentence.strip():
        raise ValueError("a sentence is a text")
    said = _THAT.search(sentence)
    text = sentence[said.end() :] if said else sentence
    hits = [(m.start(), -len(m[0].rstrip()), k, m) for k, (p, _) in enumerate(_READINGS) if (m := p.search(text))]
    if not hits:
        return None
    start, _, k, m = min(hits, key=lambda h: h[:3])
    read = _READINGS[k][1](text, m)
    subject = entity(text[:start])
    if read is None or not subject or not read[2]:
        return None
    relation, predicate, target, negated, canonical = read
    q = quantification(text[:start])
    return {"subject": subject, "predicate": predicate.lower(), "object": target, "dimension": BINDING[relation], "negated": negated or q == "empty", "quantification": q, "relation": relation, "canonical": canonical}


_TEXTS = ["subject", "predicate", "object", "dimension"]
LINK = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), T.StructField("negated", T.BooleanType()), T.StructField("quantification", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("converse", T.BooleanType())])
_ARROW = pa.struct([*((n, pa.string()) for n in _TEXTS), ("negated", pa.bool_()), ("quantification", pa.string()), ("relation", pa.string()), ("canonical", pa.string()), ("converse", pa.bool_())])


def _row(text: str | None) -> dict | None:
    found = lower(text) if text and text.strip() else None
    if found:
        found["canonical"], found["converse"] = found["canonical"] or (None, None)
    return found


@F.arrow_udf(LINK)
def lowered(text: pa.Array) -> pa.Array:
    return pa.array([_row(t) for t in text.to_pylist()], _ARROW)


def links(sentences: DataFrame, text: str) -> DataFrame:
    """The columns of sentences and, for those that have a link, its columns; the others go."""
    return sentences.withColumn("_l", lowered(F.col(text))).where("_l IS NOT NULL").select(*sentences.columns, "_l.*")
