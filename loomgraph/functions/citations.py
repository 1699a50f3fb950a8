"""Citations of articles inside a text, the links that they make, coordinates of a clause with its citations, and the headings that a place stands under.

All are functions of one text; the queries run them in Arrow batches over a table. `in_force` headings of a whole document are found once and looked up for every place (a window in the DataFrame form).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Mapping

from loomgraph import profile as P
from loomgraph.functions import cues
from loomgraph.functions.algebra import DIMENSIONS

#: The citation of one or several articles (a number before a duration is none), and what names another instrument after or around it.
_GROUPS = r"(?:\s*\(\s*[0-9A-Za-z]{1,4}\s*\))*"
_NO_TIME = r"(?!\s*(?:day|days|week|weeks|month|months|year|years|hour|hours)\b)"
_MORE = r"(?:\s*(?:" + "{}" + r")\s*\d{{1,3}}\b" + _GROUPS.replace("{", "{{").replace("}", "}}") + _NO_TIME + ")*"
ARTICLES = re.compile(rf"\bArticles\s+\d{{1,3}}\b{_GROUPS}{_MORE.format(',|and|or|to')}|\bArticle\s+\d{{1,3}}\b{_GROUPS}{_MORE.format(',|and|or')}", re.I)
_OTHER = [r"of\s+(?:the\s+|that\s+|this\s+)?Directive\b", r"of\s+(?:the\s+)?Treaty\b", r"of\s+(?:the\s+)?Charter\b", r"(?:TFEU|TEU)\b", r"of\s+(?:(?:(?!this\b|the\b)[A-Za-z]+\s+)*)Regulation\b"]
OTHER_NEXT = re.compile("|".join(rf"\A\s*{x}" for x in _OTHER), re.I)
OTHER_ANYWHERE = re.compile("|".join(rf"\b{x}" for x in _OTHER), re.I)
_THEREOF = re.compile(r"^\s*,?\s*thereof\b", re.I)
_MEMBER = re.compile(rf"(to|and|or|,)?\s*(\d{{1,3}})\b{_GROUPS}", re.I)
LONGEST_RANGE = 50

HEADINGS = {
    "eu": {"article": re.compile(r"(?m)^[ \t\xa0]*Article[\s\xa0]+(\d{1,3})[ \t\xa0]*$"), "chapter": re.compile(r"(?m)^[ \t\xa0]*CHAPTER[\s\xa0]+([IVXLCDM]+)[ \t\xa0]*$"), "section": re.compile(r"(?m)^[ \t\xa0]*Section[\s\xa0]+(\d{1,3})[ \t\xa0]*$", re.I)},
    "us": {"section": re.compile(r"§\s*(\d{1,4}[A-Za-z]?)\.")},
    "uk": {"outer": re.compile(r"\b(SCHEDULE|PART|CHAPTER)[\s\xa0]+(\d{1,3})\b")},
}


def numbers(citation: str) -> list[int]:
    """The articles that a citation names; a range is filled up, unless it is longer than LONGEST_RANGE."""
    out: list[int] = []
    for joint, n in _MEMBER.findall(citation):
        n = int(n)
        if joint.lower() == "to" and out and 0 < n - out[-1] <= LONGEST_RANGE:
            out += range(out[-1] + 1, n)
        out.append(n)
    return out


def targets(text: str, own_article: int | None = None, own_number: str | None = None) -> list[int]:
    """Articles of the same instrument that a text cites, in order; not the one that it stands in. own_number: citations "of Regulation (EU) <it>" are of the same instrument."""
    host = own_number and re.compile(rf"\A[\s\xa0]*,?[\s\xa0]*of\s+(?:(?:(?!this\b|the\b)[A-Za-z]+\s+)*)Regulation\s*(?:\(\s*EU\s*\)\s*)?(?:No\s*)?{re.escape(own_number)}\b", re.I)
    found = set()
    for m in ARTICLES.finditer(text):
        after = text[m.end() :]
        if not (host and host.match(after)) and OTHER_NEXT.match(after):
            continue
        if not (_THEREOF.match(after[:20]) and OTHER_ANYWHERE.search(text[: m.start()])):
            found.update(numbers(m[0]))
    return sorted(found - {own_article})


def cited(text: str, own_article: int | None = None, own_number: str | None = None, resolver: str = P.RESOLVERS[0], **context) -> list[str]:
    """What a text refers to, each once, by the resolver of that name."""
    if resolver not in P.RESOLVERS:
        raise ValueError(f"unknown resolver {resolver!r}")
    if resolver == P.RESOLVERS[0]:
        return [f"Article {n}" for n in targets(text, own_article, own_number)]
    from loomgraph.extract import references

    return references.objects(references.resolve(text, host_number=own_number, **context))


def links(text: str, source: str, **how) -> list[dict]:
    """A structural triple for each thing that a text refers to."""
    return [{"s": source, "p": "cross_references", "o": o, "dimension": "structural", "weight": 1.0, "provenance": {"layer": "clause_cues", "source_text": text}} for o in cited(text, **how)]


def _amount(x, what: str, positive: bool = False) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0 or positive and x == 0:
        raise ValueError(f"{what} must be a {'positive' if positive else 'non-negative'} number, got {x!r}")
    return x


def relational_effective(relational: float, others: float, scale: float = 1) -> float:
    scale = _amount(scale, "scale", positive=True)
    return round(_amount(relational, "relational") * scale / (scale + _amount(others, "others")), 6)


def contributions(text: str, scale: float = 1, **how) -> dict:
    """Cues of the five dimensions; citations add to the structural one, and the relational one gives way to the other four."""
    if not isinstance(text, str):
        raise ValueError("a clause is a text")
    found = cues.counts(text)
    out = {d: found[d] for d in DIMENSIONS}
    out["structural"] += len(cited(text, **how))
    out["relational"] = relational_effective(out["relational"], sum(out[d] for d in DIMENSIONS[:4]), scale)
    return out


def combined(text: str, base: Mapping | None = None, **how) -> dict:
    """Contributions, and one more in the dimension of the link that the clause was lowered to."""
    out = contributions(text, **how)
    if base is not None and base.get("dimension") is not None:
        if base["dimension"] not in out:
            raise ValueError(f"unknown dimension {base['dimension']!r}")
        out[base["dimension"]] += 1
    return out


def point(raw: Mapping, saturation: float | Mapping = 5) -> dict:
    """A point from contributions; the saturation is one for all or by dimension."""
    sat = {d: float(saturation.get(d, 5)) if isinstance(saturation, Mapping) else float(saturation) for d in DIMENSIONS}
    known = set(raw) | (set(saturation) if isinstance(saturation, Mapping) else set())
    if known - set(DIMENSIONS) or min(sat.values()) <= 0 or any((raw.get(d) or 0) < 0 for d in DIMENSIONS):
        raise ValueError("contributions are 0 or more, saturations positive, both by known dimensions")
    return {d: round(min(float(raw.get(d) or 0) / sat[d], 1.0), 6) for d in DIMENSIONS}


def clause_point(text: str, base: Mapping | None = None, saturation: float | Mapping = 3, **how) -> dict:
    return point(combined(text, base, **how), saturation)


def clause_point_from_profile(text: str, base: Mapping | None = None, profile: Mapping | None = None, **how) -> dict:
    p = P.resolve_profile(dict(profile or {}))
    return clause_point(text, base, p["clause_cue_saturation"], scale=p["relational_suppression_scale"], resolver=p.get("xref_resolver", P.RESOLVERS[0]), **how)


def links_from_profile(text: str, source: str, profile: Mapping | None = None, **how) -> list[dict]:
    return links(text, source, resolver=P.resolve_profile(dict(profile or {})).get("xref_resolver", P.RESOLVERS[0]), **how)


# Headings


def headings(text: str, family: str = "eu") -> list[tuple[int, str, str]]:
    """(place, level, name) of every heading, in order. Levels: article, chapter, section (eu); section (us); schedule, part, chapter (uk)."""
    found = []
    for level, pattern in HEADINGS.get(family, {}).items():
        for m in pattern.finditer(text):
            if level == "outer":
                found.append((m.start(), m[1].lower(), f"{m[1].capitalize()} {m[2]}"))
            else:
                found.append((m.start(), level, f"§ {m[1]}" if family == "us" else f"{level.capitalize()} {m[1]}"))
    return sorted(found)


def _before(found: list, offset: int) -> list:
    return found[: bisect_left(found, (offset,))]


def enclosing_unit(text: str, offset: int, family: str = "eu", found: list | None = None) -> str | None:
    """The name of the last heading strictly before a place; in the eu family, of the last article. found: headings(text, family), where they are at hand."""
    if not isinstance(text, str) or not isinstance(offset, int):
        raise ValueError("a place is an offset in a text")
    found = headings(text, family) if found is None else found
    return next((found[k][2] for k in range(bisect_left(found, (offset,)) - 1, -1, -1) if family != "eu" or found[k][1] == "article"), None)


def enclosing_units(text: str, offset: int, family: str = "eu", found: list | None = None) -> dict:
    """By level, the headings that a place stands under. A heading ends those of lower levels; what follows a schedule stands in it."""
    if not isinstance(text, str) or not isinstance(offset, int):
        raise ValueError("a place is an offset in a text")
    return chain(((level, name) for _, level, name in _before(headings(text, family) if found is None else found, offset)), family)


def chain(events: Iterable[tuple[str, str]], family: str) -> dict:
    resets = {"eu": {"chapter"}, "us": {"section"}, "uk": {"schedule"}}.get(family, set())
    state: dict = {}
    for level, name in events:
        if level == "article":
            continue
        keeps = level not in resets and not (family == "uk" and level == "part" and "schedule" not in state)
        state = {**(state if keeps else {}), level: name}
    return state


def own_sections(text: str, family: str = "us") -> set[str]:
    """Numbers of the sections that a text defines, without letters."""
    return {re.match(r"\d+", m[1])[0] for m in HEADINGS["us"]["section"].finditer(text)} if family == "us" else set()
