"""How instruments bear on one another: citations, and relations that cues of a ruleset find in articles."""

from __future__ import annotations

import re
from collections.abc import Iterable

from loomgraph.grammars import rulesets as S

#: Relations with their dimensions, and instruments by kind, EU mark, year, number and EC mark.
RELATIONS = {
    "same_definition": "structural", "cumulative": "relational", "complementary": "relational", "alternative": "causal", "substitutive": "causal", "separate_tracks": "relational", "non_cumulative": "causal",
    "no_presumption": "causal", "defers_to": "structural", "reference_redirect": "structural",
}
INSTRUMENTS = {
    ("regulation", True, "2016", "679", False): "gdpr", ("directive", False, "2002", "58", True): "eprivacy", ("directive", False, "2000", "31", True): "ecommerce", ("regulation", True, "2022", "2065", False): "dsa",
    ("directive", True, "2022", "2555", False): "nis2", ("regulation", True, "2024", "1689", False): "ai-act", ("directive", False, "95", "46", True): "dpd95",
}
TARGETS = ["cited", "repealed_alias", "none"]
_FORMS = [
    r"\b(Regulations?|Directives?)\s+(?:\((EU)\)\s+)?(\d{2,4})/(\d{1,4})(/EC)?\b",
    r"\b(Regulations?|Directives?)\s+(?:\((EU)\)\s+)?No\.?\s*(\d{1,4})/(\d{2,4})\b",
    r"\((EU)\)\s*(\d{2,4})/(\d{1,4})(/EC)?\b",
]
_CITATION = re.compile("|".join(_FORMS), re.I)
_ARTICLE = re.compile(r"Articles?\s+(\d+(?:\(\d+\))?)(?:\s*,\s*points?\s+\(([^)]+)\)\s*,)?(?:\s+(?:to|and)\s+\d+(?:\(\d+\))?)*\s+of\s*$", re.I)
_SELF = re.compile(r"\bthis\s+(?:Regulation|Directive)\b", re.I)


def instrument(key: tuple) -> str:
    """The short name of a known instrument; external:kind-year-number, with its marks, of any other."""
    kind, eu, year, number, ec = key
    return INSTRUMENTS.get(key) or "external:" + "-".join([kind, *["eu"] * eu, year, number, *["ec"] * ec])


def citations(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, instrument, words) of each citation, from left to right; one that names no kind has that of the citation before it."""
    if not isinstance(text, str):
        raise ValueError("citations are in a text")
    out, kind = [], "unknown"
    for m in _CITATION.finditer(text):
        a, b, c = m.groups()[:5], m.groups()[5:9], m.groups()[9:]
        if a[0] or b[0]:
            kind = (a[0] or b[0]).lower().removesuffix("s")
        key = (a[1], a[2], a[3], a[4]) if a[0] else (b[1], b[3], b[2], None) if b[0] else (c[0], c[1], c[2], c[3])
        out.append((m.start(), m.end(), instrument((kind, bool(key[0]), key[1], key[2], bool(key[3]))), m[0]))
    return out


def article_before(text: str, at: int) -> str | None:
    """The article that a citation is of, read from the 80 characters before it."""
    m = _ARTICLE.search(text[max(0, at - 80) : at])
    return m and (f"{m[1]}, point ({m[2]})" if m[2] else m[1])


def ruleset_violations(doc) -> list[str]:
    out = list(S.fields(doc, "", {"ruleset_id": S.named}, {"repealed_instrument_by_source": lambda x: isinstance(x, dict) and all(S.named(k) and S.named(v) for k, v in x.items())}))
    if isinstance(doc, dict):
        needed = {"cue_id": S.named, "trigger_pattern": S.pattern, "relation": S.one_of(RELATIONS), "target_mode": S.one_of(TARGETS), "max_span_chars": lambda x: S.whole(x, 1), "confidence": S.share}
        optional = {"require_all_patterns": S.each(S.pattern), "clause_end_chars": S.named, "target_lookback_chars": lambda x: S.whole(x, 0), "suppress_if_unresolved": lambda x: isinstance(x, bool)}
        out += S.rows(doc, "cues", needed, optional)
    return out


def cue_digest() -> str:
    return S.digest({"instruments": sorted([*map(str, k), v] for k, v in INSTRUMENTS.items()), "forms": _FORMS, "article": _ARTICLE.pattern, "relations": RELATIONS})


def ruleset_digest(doc: dict) -> str:
    return S.digest({"ruleset": doc, "cues": cue_digest()})


def clause(text: str, start: int, longest: int, ends: str) -> int:
    """Where the clause from a place on ends: after the first end character, or at its longest."""
    high = min(len(text), start + longest)
    m = re.compile(f"[{re.escape(ends)}]").search(text, start, high)
    return m.end() if m else high


def _targets(cue: dict, doc: dict, said: str, own: str) -> list[tuple] | None:
    """What a cue relates its article to: instruments with articles, [(None, None)] where none is named, None for no relation."""
    if cue["target_mode"] == "repealed_alias":
        alias = doc.get("repealed_instrument_by_source", {}).get(own)
        return [(alias, None)] if alias else None
    found: dict[str, str | None] = {}
    if cue["target_mode"] == "cited":
        all_cited = citations(said)
        for start, _, name, _ in all_cited:
            if name != own and name not in found:
                found[name] = article_before(said, start)
        if not found and (all_cited or _SELF.search(said)):
            return None  # only itself
    return list(found.items()) or (None if cue.get("suppress_if_unresolved", False) else [(None, None)])


def relations(articles: Iterable[dict], ruleset) -> list[dict]:
    """Every relation that a cue finds in an article, in order of source, cue, place and target; one whose target is not named is unresolved and six tenths as sure."""
    doc, found = S.checked(S.load(ruleset), ruleset_violations), {}
    name, compiled = ruleset_digest(doc), lambda p: re.compile(p, re.I | re.S)
    cues = [(c, compiled(c["trigger_pattern"]), [compiled(p) for p in c.get("require_all_patterns", [])]) for c in doc["cues"]]
    for a in S.articles(articles):
        own, text = a["instrument_id"], a["text"]
        for cue, trigger, needed in cues:
            for m in trigger.finditer(text):
                start = m.start()
                end = clause(text, start, cue["max_span_chars"], cue.get("clause_end_chars", ".;"))
                if not all(p.search(text[start:end]) for p in needed):
                    continue
                for target, article in _targets(cue, doc, text[max(0, start - cue.get("target_lookback_chars", 0)) : end], own) or []:
                    sure = float(cue["confidence"]) if target else round(cue["confidence"] * 0.6, 6)
                    key = own, a["article_id"], cue["cue_id"], start, target or "", article or ""
                    found.setdefault(key, {
                        "source_instrument": own, "source_article": a["article_id"], "relation": cue["relation"], "target_instrument": target, "target_article": article, "cue_id": cue["cue_id"],
                        "verbatim_span": text[start:end].strip(), "match_start": start, "unresolved": target is None, "confidence": sure, "basis": "statute", "ruleset_digest": name,
                    })
    return [found[k] for k in sorted(found)]


def triple(record: dict, grammar: str = "interplay-grammar") -> dict:
    """The triple of a resolved record."""
    if record["relation"] not in RELATIONS or record.get("unresolved") or record.get("target_instrument") is None:
        raise ValueError("a triple has a known relation and a named target")
    target = ":".join(filter(None, (record["target_instrument"], record.get("target_article"))))
    more = {k: record[k] for k in ("cue_id", "authority") if record.get(k) is not None}
    return {
        "s": f"{record['source_instrument']}:{record['source_article']}", "p": record["relation"], "o": target, "dimension": RELATIONS[record["relation"]], "weight": round(max(0.0, min(1.0, float(record.get("confidence", 1.0)))), 6),
        "provenance": {"basis": record.get("basis", "statute"), "verbatim_span": record.get("verbatim_span"), **more}, "grammar_id": grammar,
    }


def triples(records: Iterable[dict], grammar: str = "interplay-grammar") -> list[dict]:
    return [triple(r, grammar) for r in records]


def _maybe_text(x) -> bool:
    return x is None or isinstance(x, str)


def authority_violations(doc) -> list[str]:
    """Of a record that an authority has stated."""
    if not isinstance(doc, dict):
        return ["the record is no mapping"]
    optional = {**dict.fromkeys(("source_article", "target_article", "verbatim_span"), _maybe_text), "confidence": S.share}
    out = list(S.fields(doc, "", {"source_instrument": S.named, "target_instrument": S.named, "relation": S.one_of(RELATIONS), "basis": lambda x: x == "authority"}, optional))
    return out + list(S.fields(doc.get("authority"), "authority", {"name": S.named, "locator": S.named}))


def authority_triple(doc: dict, grammar: str = "interplay-grammar") -> dict:
    return triple(S.checked(doc, authority_violations), grammar)


def nd_system(namespace: str) -> dict:
    return S.nd_system("interplay-grammar", namespace, "relation", list(RELATIONS))


def descriptor(namespace: str) -> dict:
    return S.descriptor(nd_system(namespace), dict(RELATIONS))
