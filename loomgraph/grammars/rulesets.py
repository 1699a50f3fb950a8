"""Rulesets as data: reading them, checking their shape, and naming them by digest."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from loomgraph.documents import canonical

Found = Iterator[str]


def load(source: Any) -> dict:
    """A ruleset from a mapping, or from a JSON file by path."""
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def digest(doc: Any) -> str:
    return hashlib.sha256(canonical(doc)).hexdigest()


def named(x: Any) -> bool:
    return isinstance(x, str) and x != ""


def share(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1


def whole(x: Any, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def pattern(x: Any) -> bool:
    try:
        return named(x) and re.compile(x) is not None
    except re.error:
        return False


def each(good: Callable[[Any], bool], some: bool = False) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, list) and all(map(good, x)) and not (some and not x)


def one_of(values) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, str) and x in values


def fields(doc: Any, where: str, needed: dict[str, Callable], optional: dict[str, Callable] | None = None) -> Found:
    """What is wrong with the fields of one mapping."""
    if not isinstance(doc, dict):
        yield f"{where or 'the document'} is no mapping"
        return
    at = f"{where}." if where else ""
    for name, good in needed.items():
        if not good(doc.get(name)):
            yield f"{at}{name} is wrong or missing"
    for name, good in (optional or {}).items():
        if name in doc and not good(doc[name]):
            yield f"{at}{name} is wrong"


def rows(doc: dict, name: str, needed: dict, optional: dict | None = None) -> Found:
    """What is wrong with a list of mappings that must not be empty."""
    table = doc.get(name)
    if not isinstance(table, list) or not table:
        yield f"{name} is no list with entries"
        return
    for k, row in enumerate(table):
        yield from fields(row, f"{name}[{k}]", needed, optional)


def checked(doc: Any, violations: Callable[[Any], list[str]]) -> dict:
    wrong = violations(doc)
    if wrong:
        raise ValueError(f"malformed ruleset: {'; '.join(wrong)}")
    return doc


def articles(rows_: Any) -> list[dict]:
    """Articles (instrument_id, article_id, text), or an error."""
    found = list(rows_)
    for k, a in enumerate(found):
        if not isinstance(a, dict) or not named(a.get("instrument_id")) or not named(a.get("article_id")) or not isinstance(a.get("text"), str):
            raise ValueError(f"articles[{k}] has no instrument_id, article_id or text")
    return found


def nd_system(name: str, namespace: str, slot: str, values: list[str] | None = None, ontology: tuple[str, str] | None = None) -> dict:
    """The nD system of a grammar with one axis: a closed vocabulary, or numbers over an external one."""
    if ontology:
        axis = {"value_type": "number", "cardinality": "many", "vocabulary_mode": "external", "ontology_id": ontology[0], "ontology_version": ontology[1]}
    else:
        axis = {"value_type": "controlled_identifier", "cardinality": "one", "vocabulary_mode": "closed", "vocabulary": sorted(values)}
    return {
        "id": name, "namespace": namespace, "version": "1.0.0", "version_5d": "1.0-draft", "axes": {slot: axis}, "bindings": [{"form_slot": slot, "allowed_axes": [slot], "required": ontology is None}],
        "ontology_relations": [], "validation": {"unknown_values": "reject", "missing_coordinates": "reject", "provenance_required": True},
    }


def descriptor(system: dict, binding: dict[str, str]) -> dict:
    return {"plane": system["id"], "language_version": system["version"], "nd_system": system, "binding": binding, "examples": [], "contract_version": "1.0-draft"}
