"""Penalties in articles: kind, amount, share of turnover, bound, whom they fall on, and the provisions whose infringement they follow."""

from __future__ import annotations

import re
from collections.abc import Iterable

from loomgraph.grammars import rulesets as S
from loomgraph.grammars.interplay import _maybe_text

#: Kinds of penalties, bounds and combinations, and the phrases that provisions follow.
KINDS = ["administrative_fine", "periodic_penalty_payment", "penalty", "criminal_sanction"]
BOUNDS, COMBINATIONS = ["ceiling", "floor_of_maximum", "minimum"], ["whichever_is_higher", "whichever_is_lower"]
DIMENSION = "causal"
_i = lambda p: re.compile(p, re.I)
_PARAGRAPH = re.compile(r"(?:^|\n)\s*(\d{1,2})\.\s")
_PROVISIONS = _i(r"\b(Articles?|Chapters?)\s+")
_NUMBER, _ROMAN = re.compile(r"\d+(?:\(\d+\))?(?:\s+to\s+\d+(?:\(\d+\))?)?|\(\d+\)"), re.compile(r"[IVXLCDM]+\b")
_NEXT = _i(r"\s*(?:,|and|or)\s*")
_EXCLUDED = _i(r"\b(?:other\s+than|with\s+the\s+exception\s+of|except(?:ing)?|excluding)\b\s*(?:those\s+)?(?:laid\s+down\s+in\s+|referred\s+to\s+in\s+|set\s+out\s+in\s+)?")
_ANY_OF = _i(r"\b(?:infringements?\s+of|non[- ]compliance\s+with)\s+(?:any\s+of\s+)?(?:the\s+following\s+)?provisions?\b")
_BREACH = _i(r"\bfail(?:s|ed)?\s+to\b|\binfringe(?:s|d)?\b|\bnon[- ]compliance\s+(?:of|with)\b|\bin\s+breach\s+of\b|\brefuse(?:s|d)?\s+to\b|\bsupply\s+incorrect,\s+incomplete\s+or\s+misleading\s+information\b")
REACH = 300
_EUR = _i("\\bEUR\\s*(\\d[\\d\\s\xa0]*\\d)\\b|\\b(\\d[\\d\\s\xa0]*\\d)\\s*EUR\\b")
_PERCENT = re.compile(r"(\d+(?:[.,]\d+)?)\s*%")
_BASIS = re.compile(r"%\s*of\s+(.+?)(?=,\s*whichever\b|,\s*or\b|\bor\s+EUR\b|;|\.|:|\bwhere\b|\bin\s+order\s+to\b|$)", re.I | re.S)
_ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True))
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
_SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
_WORDS = "|".join([*_ONES, *_TENS, *_SCALES])
_EUROS = _i(rf"\b((?:(?:{_WORDS}|and)\s+)*(?:{_WORDS}))\s+euros?\b")


def ruleset_violations(doc) -> list[str]:
    out = list(S.fields(doc, "", {"ruleset_id": S.named}))
    if isinstance(doc, dict):
        out += S.rows(doc, "bound_type_phrases", {"pattern": S.pattern, "bound_type": S.one_of(BOUNDS)})
        out += S.rows(doc, "combination_phrases", {"pattern": S.pattern, "combination_rule": S.one_of(COMBINATIONS)})
        needed = {"cue_id": S.named, "trigger_pattern": S.pattern, "penalty_kind": S.one_of(KINDS), "max_span_chars": lambda x: S.whole(x, 1), "expects_amount": lambda x: isinstance(x, bool), "confidence": S.share}
        addressee = lambda x: isinstance(x, dict) and S.pattern(x.get("pattern")) and S.named(x.get("label"))
        out += S.rows(doc, "cues", needed, {"require_all_patterns": S.each(S.pattern), "clause_end_chars": S.named, "addressee_patterns": S.each(addressee)})
    return out


def cue_digest() -> str:
    patterns = (_PARAGRAPH, _PROVISIONS, _NUMBER, _ROMAN, _EXCLUDED, _ANY_OF, _BREACH, _EUR, _PERCENT, _BASIS, _EUROS)
    return S.digest({"kinds": KINDS, "dimension": DIMENSION, "patterns": [p.pattern for p in patterns], "reach": REACH})


def ruleset_digest(doc: dict) -> str:
    return S.digest({"ruleset": doc, "cues": cue_digest()})


def clause_end(text: str, start: int, longest: int, ends: str) -> int:
    """After the first end character (a full stop only where no comma follows it); an error where the clause is longer."""
    m = re.compile("|".join(r"\.(?!\s*,)" if c == "." else re.escape(c) for c in ends)).search(text, start, min(len(text), start + longest))
    if m is None:
        raise ValueError(f"no clause end within {longest} characters of {start}")
    return m.end()


def paragraph_before(text: str, at: int) -> tuple[str | None, int]:
    """The number and place of the last numbered paragraph that begins in the 500 characters before."""
    found = [(m[1], m.start()) for m in _PARAGRAPH.finditer(text, max(0, at - 500), at)]
    return found[-1] if found else (None, at)


def provision_run(text: str, at: int) -> tuple[list[str], int]:
    """The provisions of one run ("Articles 8, 11 and 25 to 39", "Chapter IV") and its end; a bare (3) is of the article before it."""
    m = _PROVISIONS.match(text, at)
    if not m:
        return [], at
    chapter = m[1].lower().startswith("chapter")
    out, last, at = [], "", m.end()
    while found := (_ROMAN if chapter else _NUMBER).match(text, at):
        said, at = found[0], found.end()
        if not said.startswith("("):
            last = re.match(r"\d*", said)[0]
        out.append(("Chapter " if chapter else "") + (last + said if said.startswith("(") else said))
        joint = _NEXT.match(text, at)
        if not joint:
            break
        at = joint.end()
    return list(dict.fromkeys(out)), at


def provisions(text: str, start: int, end: int) -> list[str]:
    return list(dict.fromkeys(p for m in _PROVISIONS.finditer(text, start, end) for p in provision_run(text, m.start())[0]))


def infringed(text: str) -> tuple[list[str], list[str]]:
    """The provisions whose infringement is meant, and those excepted: exceptions are read first and masked; then all after a phrase like "infringements of the following
    provisions", or else those within REACH characters after each word for a breach."""
    excepted, masked = [], text
    for m in _EXCLUDED.finditer(text):
        found, end = provision_run(text, m.end())
        if found:
            excepted += found
            masked = masked[: m.start()] + " " * (end - m.start()) + masked[end:]
    wide = _ANY_OF.search(masked)
    starts = [(wide.end(), len(masked))] if wide else [(m.end(), min(len(masked), m.end() + REACH)) for m in _BREACH.finditer(masked)]
    found = [p for a, z in starts for p in provisions(masked, a, z)]
    return [p for p in dict.fromkeys(found) if p not in excepted], list(dict.fromkeys(excepted))


def nodes(instrument: str, provision: str) -> list[str]:
    """The articles of a provision as nodes: a range is filled up, points are left out."""
    if provision.startswith("Chapter "):
        return [f"{instrument}:Chapter.{provision[8:]}"]
    if m := re.fullmatch(r"(\d+)\s+to\s+(\d+)", provision):
        return [f"{instrument}:Art.{n}" for n in range(int(m[1]), int(m[2]) + 1)]
    return [f"{instrument}:Art.{(re.match(r'\d+', provision) or [provision])[0]}"]


def number(words: str) -> int | None:
    """A number in words."""
    total = part = 0
    found = re.findall(rf"\b(?:{_WORDS})\b", words.lower())
    for w in found:
        if w == "hundred":
            part = (part or 1) * 100
        elif w in _SCALES:
            total, part = total + (part or 1) * _SCALES[w], 0
        else:
            part += _ONES.get(w, _TENS.get(w, 0))
    return total + part if found else None


def amount(text: str) -> int | None:
    """The first amount in euro: in digits on either side of EUR, or in words."""
    if m := _EUR.search(text):
        return int(re.sub(r"\s", "", m[1] or m[2]))
    m = _EUROS.search(text)
    return number(m[1]) if m else None


def percentage(text: str) -> tuple[float | None, str | None]:
    """The first percentage, and what it is of."""
    m = _PERCENT.search(text)
    if not m:
        return None, None
    of = _BASIS.search(text, m.start())
    basis = re.sub(r"\s*per\s+day\s*$", "", of[1].strip(), flags=re.I) if of else ""
    basis = re.sub(r"^(?:the|a|an)\s+", "", basis, flags=re.I).strip().rstrip(" ,;").strip()
    return float(m[1].replace(",", ".")), basis or None


def _first(text: str, table: list[dict], field: str, other):
    return next((row[field] for row in table if re.search(row["pattern"], text, re.I)), other)


def penalties(articles: Iterable[dict], ruleset) -> list[dict]:
    """Every penalty that a cue finds in an article, in order of source, cue and place. One without the amount or bound that its cue expects is unresolved and six tenths as sure."""
    doc, found = S.checked(S.load(ruleset), ruleset_violations), {}
    name, compiled = ruleset_digest(doc), lambda p: re.compile(p, re.I | re.S)
    cues = [(c, compiled(c["trigger_pattern"]), [compiled(p) for p in c.get("require_all_patterns", [])]) for c in doc["cues"]]
    for a in S.articles(articles):
        text = a["text"]
        for cue, trigger, needed in cues:
            for m in trigger.finditer(text):
                start = m.start()
                end = clause_end(text, start, cue["max_span_chars"], cue.get("clause_end_chars", "."))
                said = text[start:end]
                if not all(p.search(said) for p in needed):
                    continue
                paragraph, begin = paragraph_before(text, start)
                meant, excepted = infringed(text[begin:end])
                euro, (percent, basis) = amount(said), percentage(said)
                bound = _first(said, doc["bound_type_phrases"], "bound_type", "unspecified")
                unresolved = cue["expects_amount"] and (euro is None and percent is None or bound == "unspecified")
                to = cue.get("addressee_patterns", [])
                found.setdefault((a["instrument_id"], a["article_id"], cue["cue_id"], start), {
                    "source_instrument": a["instrument_id"], "source_article": a["article_id"], "paragraph": paragraph, "penalty_kind": cue["penalty_kind"],
                    "addressee": _first(text[begin:end], to, "label", None) or _first(text[:end], to, "label", None), "infringed_provisions": meant, "excluded_provisions": excepted,
                    "scope": "the instrument, other than " + ", ".join(f"Art. {p}" for p in excepted) if excepted and not meant else None, "fixed_amount_eur": euro, "turnover_percentage": percent,
                    "turnover_basis": basis, "combination_rule": _first(said, doc["combination_phrases"], "combination_rule", "none"), "bound_type": bound, "per_day": cue["penalty_kind"] == "periodic_penalty_payment",
                    "verbatim_span": said.strip(), "match_start": start, "cue_id": cue["cue_id"], "confidence": round(cue["confidence"] * 0.6, 6) if unresolved else float(cue["confidence"]), "unresolved": unresolved,
                    "basis": "statute", "ruleset_digest": name,
                })
    return [found[k] for k in sorted(found)]


_DETAIL = {
    "basis": "statute", "verbatim_span": None, "paragraph": None, "addressee": None, "excluded_provisions": [], "scope": None, "fixed_amount_eur": None, "turnover_percentage": None, "turnover_basis": None,
    "combination_rule": "none", "bound_type": "unspecified",
}


def node(record: dict) -> str:
    return f"{record['source_article']}{'({})'.format(record['paragraph']) if record.get('paragraph') else ''}:{record['penalty_kind']}"


def triples(record: dict, grammar: str = "penalty-grammar") -> list[dict]:
    """One triple for each article whose infringement the penalty follows."""
    if record["penalty_kind"] not in KINDS or record.get("unresolved"):
        raise ValueError("triples are of a resolved penalty of a known kind")
    meant = record.get("infringed_provisions") or []
    detail = {k: record.get(k, v) for k, v in _DETAIL.items()} | {"provisions_detail": meant, "per_day": bool(record.get("per_day", False))}
    detail |= {k: record[k] for k in ("cue_id", "authority") if record.get(k) is not None}
    weight = round(max(0.0, min(1.0, float(record.get("confidence", 1.0)))), 6)
    subjects = dict.fromkeys(s for p in meant for s in nodes(record["source_instrument"], p))
    return [{"s": s, "p": record["penalty_kind"], "o": node(record), "dimension": DIMENSION, "weight": weight, "provenance": detail, "grammar_id": grammar} for s in subjects]


def all_triples(records: Iterable[dict], grammar: str = "penalty-grammar") -> list[dict]:
    return [t for r in records for t in triples(r, grammar)]


def authority_violations(doc) -> list[str]:
    """Of a record that an authority has stated."""
    if not isinstance(doc, dict):
        return ["the record is no mapping"]
    flag = lambda x: isinstance(x, bool)
    number_ = lambda x: x is None or isinstance(x, (int, float)) and not isinstance(x, bool)
    optional = {
        **dict.fromkeys(("infringed_provisions", "excluded_provisions"), S.each(S.named)), **dict.fromkeys(("paragraph", "addressee", "scope", "turnover_basis", "verbatim_span"), _maybe_text),
        "fixed_amount_eur": lambda x: number_(x) and not isinstance(x, float), "turnover_percentage": number_, "combination_rule": S.one_of([*COMBINATIONS, "none"]), "bound_type": S.one_of([*BOUNDS, "unspecified"]),
        "per_day": flag, "unresolved": flag, "confidence": S.share,
    }
    out = list(S.fields(doc, "", {"source_instrument": S.named, "source_article": S.named, "penalty_kind": S.one_of(KINDS), "basis": lambda x: x == "authority"}, optional))
    return out + list(S.fields(doc.get("authority"), "authority", {"name": S.named, "locator": S.named}))


def authority_triples(doc: dict, grammar: str = "penalty-grammar") -> list[dict]:
    return triples(S.checked(doc, authority_violations), grammar)


def nd_system(namespace: str) -> dict:
    return S.nd_system("penalty-grammar", namespace, "penalty_kind", KINDS)


def descriptor(namespace: str) -> dict:
    return S.descriptor(nd_system(namespace), dict.fromkeys(KINDS, DIMENSION))
