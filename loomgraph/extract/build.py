"""Candidates to statements: ends trimmed, negation read, overlaps resolved, deadlines bound to the act that they govern.

`extract` is a function of one unit. Over a table it runs in Arrow batches (`statements`), one unit a row; nothing is shared between units, so the table is read once and not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import documents as D
from loomgraph.extract import rules as R
from loomgraph.functions.text import PREDICATES

Span = tuple[int, int]
_BLANK = " \t\r\n\f\v"
#: What is taken off the ends of a subject or an object.
_ARTICLE = re.compile(r"^(?:one of the|one of|the|an|a)\s+", re.I)
_DEEMED = "shall be deemed to be|shall be deemed|shall be held to be|shall be held|is to be|shall|may|must|should"
_MODAL_FIRST = re.compile(rf"^(?:{_DEEMED})\s+", re.I)
_SUBJECT_FIRST = re.compile(rf"^(?:the\s+|a\s+|an\s+)?[A-Za-z][\w\s,'-]{{0,60}}?\s+(?:{_DEEMED})\b,?\s*", re.I)
_MODAL = re.compile(r"\b(?:shall|may|must|should)\b", re.I)


def trimmed(text: str, span: Span) -> Span:
    s, e = span
    while s < e and text[s] in _BLANK:
        s += 1
    while e > s and text[e - 1] in _BLANK:
        e -= 1
    return s, e


def without(text: str, span: Span, lead: re.Pattern, again: bool = False) -> Span:
    """A span without what leads it in, once or as often as it is there."""
    s, e = trimmed(text, span)
    while m := lead.match(text[s:e]):
        s, e = trimmed(text, (s + m.end(), e))
        if not again:
            break
    return s, e


def without_article(text: str, span: Span) -> Span:
    return without(text, span, _ARTICLE)


def without_modals(text: str, span: Span) -> Span:
    return without(text, span, _MODAL_FIRST, again=True)


def without_subject(text: str, span: Span) -> Span:
    return without(text, span, _SUBJECT_FIRST)


def before_modal(text: str, span: Span) -> Span:
    m = _MODAL.search(text, span[0] + 1, span[1])
    return (span[0], m.start()) if m else span


def end_span(text: str, span: Span, modals: bool = False) -> Span | None:
    """What is left of an end, or nothing."""
    span = without_article(text, span)
    span = without_modals(text, span) if modals else span
    return span if span[1] > span[0] else None


def said(text: str, span: Span) -> str:
    return D.statement_text(text[span[0] : span[1]])


def ends(text: str, c: R.Candidate) -> tuple[Span, Span] | None:
    """The spans of subject and object that a candidate comes to."""
    if not c.subj or not c.obj:
        return None
    subj, obj = (before_modal(text, c.subj), before_modal(text, c.obj)) if c.cut_modals else (c.subj, c.obj)
    obj = without_subject(text, obj) if c.inner_obj else obj
    found = end_span(text, subj, c.bare_subj), end_span(text, obj, c.bare_obj)
    return found if all(found) else None


# Negation

_NEGATOR = re.compile(r"\b(?:not|never|no|cannot|can't|unable)\b", re.I)


@lru_cache(4)
def _negators(text: str) -> tuple[Span, ...]:
    return tuple(m.span() for m in _NEGATOR.finditer(text))


NEVER_NEGATED = {"requires", "deadline_of", "addressed_to"}


def negation_v34(text: str, clause: Span | None, subj: Span | None, predicate: str, force: str | None = None) -> str:
    """present: a negator in the clause outside its subject; uncertain: one elsewhere in the unit; absent: none."""
    if force is not None or predicate in NEVER_NEGATED:
        return force or "absent"
    if clause is None:
        return "uncertain"
    s, e = subj or (clause[0], clause[0])
    everywhere = _negators(text)
    if not everywhere and _NEGATOR.search(text[clause[0] : clause[1]]) is None:
        return "absent"
    spans = [(clause[0] + m.start(), clause[0] + m.end()) for m in _NEGATOR.finditer(text[clause[0] : clause[1]])]
    if any(a < s or b > e for a, b in spans):
        return "present"
    return "uncertain" if any(not clause[0] <= a < clause[1] for a, _ in everywhere) else "absent"


NEGATION: dict[str, Callable] = {"v34": negation_v34}


def register_negation(version: str, rule: Callable) -> None:
    """A further rule of negation under a name that is not taken."""
    if not isinstance(version, str) or not version or version in NEGATION:
        raise ValueError(f"no free name: {version!r}")
    NEGATION[version] = rule


def negate(text: str, clause: Span | None, subj: Span | None, predicate: str, version: str = "v34", force: str | None = None) -> str:
    found = NEGATION[version](text, clause, subj, predicate, force=force)
    if found not in D.NEGATIONS:
        raise ValueError(f"rule {version!r} says {found!r}")
    return found


# Statements


@dataclass(frozen=True)
class Built:
    statement: dict
    clause: Span
    subj: Span
    obj: Span
    group: str | None = None
    free: bool = False


def layer_of(predicate: str, where: str | None = None) -> str:
    if predicate == "is_a":
        return "deep"
    if where:
        return "surface" if "recital" in where.lower() else "domain"
    return "surface" if predicate == "legislative_purpose_of" else "domain"


def _identified(doc: dict, uri: str, date: str) -> dict:
    span = doc["provenance"]
    source = D.statement_text(f"{doc['predicate']}|{doc['subj']}|{doc['obj']}|{span['start']}-{span['end']}")
    return {"id": D.statement_id(uri, date, D.statement_hash(source))} | {k: v for k, v in doc.items() if k != "id"}


def statement(text: str, c: R.Candidate, uri: str = "extracted-unit", date: str = "n/a", version: str = "v34", where: str | None = None, found: tuple[Span, Span] | None = None) -> Built | None:
    """The statement of a candidate, if its ends are not empty."""
    found = found or ends(text, c)
    if found is None:
        return None
    subj, obj = found
    subj_text, obj_text = said(text, subj), said(text, obj)
    if subj_text and obj_text:
        obj_text = {"addressed_to": R.recipient, "deadline_of": R.deadline}.get(c.predicate, str)(obj_text)
    if not subj_text or not obj_text:
        return None
    clause = min(c.clause[0], subj[0], obj[0]), max(c.clause[1], subj[1], obj[1])
    doc = {
        "subj": subj_text, "obj": obj_text, "predicate": c.predicate, "dimension": PREDICATES[c.predicate], "layer": layer_of(c.predicate, where), "weight": 1.0,
        "edge_confidence": round(min(1.0, max(0.0, c.confidence)), 6), "provenance": {"start": clause[0], "end": clause[1]},
        "negation": negate(text, clause, subj, c.predicate, version, c.negation), "extraction_rule_id": c.rule,
    }
    doc = _identified(doc, uri, date)
    return Built(doc, clause, subj, obj, c.group, c.free) if D.is_valid("statement", doc) else None


def overlap(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def resolved(built: list[Built], counts: Counter | None = None) -> list[Built]:
    """Of statements whose clauses overlap the first stays, unless they may stand together: free ones, those of one chapeau, and certain pairs of predicates."""
    kept: list[Built] = []
    for b in built:
        together = lambda o: b.group is not None and b.group == o.group or {b.statement["predicate"], o.statement["predicate"]} in R.TOGETHER  # noqa: B023, E731
        if b.free or not any(not o.free and overlap(b.clause, o.clause) and not together(o) for o in kept):
            kept.append(b)
        elif counts is not None:
            counts["overlapping"] += 1
    return kept


# Deadlines and the acts that they govern

_PRIORITY = ["addressed_to", "performs", "competence_of", "requires", "except_when"]
_STOP = re.compile(r"[.]\s*")
_HEADING = re.compile(r"^(?:Article|Chapter|Section|Annex|Title)\s+\d+\b", re.I)
_SCRAP = re.compile(rf"^(?:\d{{1,4}}|\d{{1,2}}\s+{R.MONTHS}(?:\s+\d{{4}})?)$", re.I)
_SHALL = r"(?:shall|must|may(?!\s+\d))"
_SECOND_ACT = re.compile(rf"\b(?:and|or)\s+(?P<modal>{_SHALL})\b", re.I)
_CONDITION = re.compile(r"\b(?:unless|except\s+where|except|save\s+where|if|where)\b", re.I)
_ACTIVE = re.compile(rf"\b{_SHALL}\b(?:\s*,\s*[^,]{{1,80}},)*(?!\s*be\b)\s*(?P<act>[^.;:,]{{1,200}})", re.I)
_PASSIVE = re.compile(rf"\b{_SHALL}\s+(?P<act>be\s+(?:[a-z]+ly\s+)?(?P<verb>[a-z]+)[^.;:,]*)", re.I)
#: Participles that don't end in -ed or -en.
PARTICIPLES = frozenset("""made given taken kept held brought sent built done put set shown known drawn begun chosen broken spoken found understood met heard read said told sold left felt dealt meant written seen
gone come become grown worn torn born sworn thrown blown flown withdrawn paid lost sought bought caught taught fought""".split())  # fmt: skip


def _trusted(b: Built) -> bool:
    """Whether a statement of a condition or an exception names an act."""
    s, rule = b.statement, b.statement["extraction_rule_id"]
    if s["predicate"] == "requires":
        return rule != "T3-requires-subject-to-condition" and len(s["subj"].split()) > 1
    return s["predicate"] != "except_when" or rule in ("T3-except_when-unless", "T3-except_when-except-where")


def _act(b: Built) -> str:
    return b.statement["subj" if b.statement["predicate"] == "addressed_to" else "obj"]


def _dangles(act: str) -> bool:
    return re.search(r",\s*(?:and|or)\s*$", act.strip(), re.I) is not None


def one_clause(text: str, a: Span, b: Span) -> bool:
    """Whether spans touch, or are at most 200 characters apart without a stop between."""
    low, high = min(a[1], b[1]), max(a[0], b[0])
    return overlap(a, b) or high <= low or high - low <= 200 and not re.search("[.;:]", text[low:high])


def _sentence(text: str, near: Span) -> Span:
    after = _STOP.search(text, near[1])
    return max([0, *(m.end() for m in _STOP.finditer(text, 0, near[0]))]), after.start() if after else len(text)


def _window(text: str, near: Span) -> Span:
    """The sentence from its last condition and its last further act on."""
    start, end = _sentence(text, near)
    start = max([start, *(m.end() for m in _CONDITION.finditer(text, start, near[1]))])
    return max([start, *(m.start("modal") for m in _SECOND_ACT.finditer(text, start, near[1]))]), end


def _active(text: str, near: Span) -> str | None:
    start, end = _window(text, near)
    m = _ACTIVE.search(text[start:end])
    act = said(text, (start + m.start("act"), start + m.end("act"))) if m else ""
    return act if act and not _HEADING.match(act) else None


def _passive(text: str, near: Span) -> str | None:
    start, end = _window(text, near)
    for m in _PASSIVE.finditer(text[start:end]):
        verb = m["verb"].lower()
        act = said(text, (start + m.start("act"), start + m.end("act"))) if verb in PARTICIPLES or verb.endswith(("ed", "en")) else ""
        if act and not _HEADING.match(act):
            return act
    return None


def _shall_be(text: str, near: Span) -> str | None:
    """The sentence up to "shall be" and a word."""
    start, end = _sentence(text, near)
    m = re.search(r"\bshall\s+be\s+[a-z]+\b", text[start:end], re.I)
    return said(text, (start, start + m.end())) or None if m else None


def _over_list(text: str, near: Span, built: list[Built]) -> Built | None:
    """A statement that begins between the sentence's start and 80 characters past its last colon."""
    start = _sentence(text, near)[0]
    colon = text.rfind(":", start, near[0])
    if colon < 0:
        return None
    return next((o for p in _PRIORITY for o in built if o.statement["predicate"] == p and (p != "requires" or _trusted(o)) and start <= o.clause[0] <= colon + 80), None)


def _companion(text: str, b: Built, pool: list[Built], wide: bool) -> tuple[Built | None, bool]:
    """The statement whose act a deadline governs, by priority; or whether the deadline is part of a condition and keeps its own subject."""
    for predicate in _PRIORITY:
        if wide and predicate == "except_when":
            continue
        for o in pool:
            if o is b or o.statement["predicate"] != predicate or not _trusted(o) or wide and _dangles(_act(o)):
                continue
            if predicate == "requires":
                if overlap(b.clause, o.subj):
                    return None, True
                if one_clause(text, b.clause, o.obj):
                    return o, False
                continue
            where = o.obj if wide else o.clause
            low, high = min(where[1], b.clause[0]), max(where[1], b.clause[0]) + 10
            if not (wide and _SECOND_ACT.search(text, low, high)) and one_clause(text, b.clause, where):
                return o, False
    return None, False


def bound(text: str, built: list[Built], everything: list[Built], uri: str, date: str) -> list[Built]:
    """Deadlines with the act that they govern as subject; a free one without any goes, another keeps its own."""
    out = []
    for b in built:
        if b.statement["predicate"] != "deadline_of":
            out.append(b)
            continue
        wide = b.statement["extraction_rule_id"] in ("T3-deadline_of-relative-by-date", "T3-deadline_of-periodic")
        o, condition = _companion(text, b, everything if wide else built, wide)
        if condition:
            out.append(b)
            continue
        o = o or _over_list(text, b.clause, built)
        act = _act(o) if o else (_active(text, b.clause) or _passive(text, b.clause)) if wide else _shall_be(text, b.clause)
        if wide and act:
            act = R.without_deadline(act) if not (o and _HEADING.match(act.strip())) else None
            act = None if act and _SCRAP.fullmatch(act.strip()) else act
        if not act:
            out += [b] * (not b.free)
            continue
        doc = _identified(b.statement | {"subj": act}, uri, date)
        if D.is_valid("statement", doc):
            out.append(replace(b, statement=doc))
    return out


def extract_with_spans(text: str, uri: str = "extracted-unit", date: str = "n/a", version: str = "v34", where: str | None = None, counts: Counter | None = None) -> list[Built]:
    """The statements of a unit, in canonical order, with their spans. counts: gets candidates, those without ends, and overlapping ones."""
    if not isinstance(text, str):
        raise ValueError("a unit is a text")
    found = R.unit_candidates(text, where)
    built = [b for c in found if (b := statement(text, c, uri, date, version, where))]
    if counts is not None:
        counts.update(candidates=len(found), unfinished=len(found) - len(built))
    kept = bound(text, resolved(built, counts), built, uri, date)
    return sorted(kept, key=lambda b: D.statement_order(b.statement))


def extract(text: str, **how) -> list[dict]:
    return [b.statement for b in extract_with_spans(text, **how)]


STATEMENT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "subj", "obj", "predicate", "dimension", "layer")), T.StructField("weight", T.DoubleType()), T.StructField("edge_confidence", T.DoubleType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("negation", T.StringType()), T.StructField("extraction_rule_id", T.StringType()),
])
_ARROW = pa.list_(pa.struct([*((n, pa.string()) for n in ("id", "subj", "obj", "predicate", "dimension", "layer")), ("weight", pa.float64()), ("edge_confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("negation", pa.string()), ("extraction_rule_id", pa.string())]))


def flat(doc: dict) -> dict:
    return {k: v for k, v in doc.items() if k != "provenance"} | doc["provenance"]


def _flat(text: str, uri: str, date: str, where: str | None) -> list[dict]:
    return [flat(s) for s in extract(text, uri=uri, date=date, where=where)]


@lru_cache(2048)
def _flat_again(text: str, uri: str, date: str, where: str | None) -> list[dict]:
    """For short units, which come again in headings and standing clauses."""
    return _flat(text, uri, date, where)


@F.arrow_udf(T.ArrayType(STATEMENT))
def extracted(text: pa.Array, uri: pa.Array, date: pa.Array, where: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (text, uri, date, where)), strict=True)
    of = lambda row: _flat_again(*row) if len(row[0]) <= 500 else _flat(*row)
    return pa.array([of(row) if all(row[:3]) else [] for row in rows], _ARROW)


def statements(units: DataFrame, text: str, uri: str, date: str, where: str | None = None) -> DataFrame:
    """The columns of units, one row for each statement of a unit. A unit without text has none."""
    found = extracted(F.col(text), F.col(uri), F.col(date), F.col(where) if where else F.lit(None).cast("string"))
    return units.withColumn("_s", F.explode(found)).select(*units.columns, "_s.*")
