"""Resolution profiles: the settings of a run, checked, completed and pinned by a digest. Documents, so driver-side."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

#: Fixed values. The tie-break salt has no default here: a run states its own, in the profile or to resolve_profile().
DEFAULTS = {
    "k": 5, "n_min": 3, "r": 2, "d_blend_weights": {"links": 0.5, "nesting": 0.5}, "link_saturation": 5, "anchor_saturation": 2, "point_saturation": 5, "clause_cue_saturation": 3,
    "match_blend_weights": {"term": 0.7, "structural": 0.3}, "confidence_floor": 0.05, "staleness_window_seconds": 3600, "relational_suppression_scale": 1,
}
RESOLVERS = ["article-v1", "shared-v2"]
WEIGHTS = ("d_blend_weights", "match_blend_weights")


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _count(x: Any) -> bool:
    """A positive whole number, written as an integer or not."""
    return _number(x) and x > 0 and x == int(x)


def _text(x: Any) -> bool:
    return isinstance(x, str) and x != ""


_RULES = {
    "profile_id": (_text, "a text"),
    **dict.fromkeys(("k", "n_min", "r", "link_saturation", "anchor_saturation", "point_saturation", "clause_cue_saturation"), (_count, "a positive whole number")),
    "relational_suppression_scale": (lambda x: _number(x) and x > 0, "a positive number"),
    "confidence_floor": (lambda x: _number(x) and 0 <= x <= 1, "within 0 and 1"),
    "staleness_window_seconds": (lambda x: _number(x) and x >= 0, "0 or more"),
    **dict.fromkeys(("tiebreak_salt", "schema_version", "segmenter_digest", "table_digest"), (_text, "a text")),
    "xref_resolver": (lambda x: _text(x) and x in RESOLVERS, "a known resolver"),
}


def _plain(x: Any) -> Any:
    """Whole floats as integers, so that 5 and 5.0 are one profile."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return int(x) if isinstance(x, float) and x.is_integer() else x


def profile_violations(doc: Any) -> list[str]:
    """What is wrong with a profile; never raises."""
    if not isinstance(doc, dict):
        return ["a profile is a mapping"]
    out = [f"unknown field {k!r}" for k in sorted(map(str, set(doc) - set(_RULES) - set(WEIGHTS)))]
    out += [f"{f} must be {said}" for f, (good, said) in _RULES.items() if (f in doc or f == "profile_id") and not good(doc.get(f))]
    for f in WEIGHTS:
        w = doc.get(f, DEFAULTS[f])
        if not isinstance(w, dict) or set(w) != set(DEFAULTS[f]) or not all(_number(x) and x >= 0 for x in w.values()):
            out.append(f"{f} must map {' and '.join(DEFAULTS[f])} to weights of 0 or more")
        elif not 0 < sum(w.values()) < math.inf:
            out.append(f"{f} must have a positive sum")
    return out


def resolve_profile(doc: dict, salt: str | None = None) -> dict:
    """doc over the defaults; weights are merged by name; the first resolver is what goes without saying."""
    full = DEFAULTS | ({"tiebreak_salt": salt} if salt else {}) | {k: DEFAULTS[k] | v if k in WEIGHTS else v for k, v in doc.items()}
    return _plain({k: v for k, v in full.items() if (k, v) != ("xref_resolver", RESOLVERS[0])})


def profile_digest(doc: dict, salt: str | None = None) -> str:
    """SHA-256 of the resolved profile as canonical JSON: what is left out and what is set to its default are the same."""
    return hashlib.sha256(json.dumps(resolve_profile(doc, salt), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
