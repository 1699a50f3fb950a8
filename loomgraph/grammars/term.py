"""The term grammar: a pinned profile of a corpus, weights of a text under it, and the claims that they make. The profile of a large corpus is a table (operators.retrieval); this is its pinned form."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from loomgraph.functions.text import STOPWORDS
from loomgraph.grammars import rulesets as S
from loomgraph.operators.retrieval import B, K1

TOKEN = "[a-zA-Z]{2,}"


def tokens(text: str) -> list[str]:
    return [t for t in map(str.lower, re.findall(TOKEN, text)) if t not in STOPWORDS]


def profile(texts: Mapping[str, str], profile_id: str = "term-nd-default") -> dict:
    """Document frequencies, mean length and the tokenizer of a corpus, named by digest."""
    found = [tokens(t) for t in texts.values()]
    df = Counter(t for words in found for t in set(words))
    doc = {
        "profile_id": profile_id, "n_docs": len(found), "avgdl": round(sum(map(len, found)) / len(found), 6) if found else 0.0, "k1": K1, "b": B, "vocabulary": sorted(df), "df": {t: df[t] for t in sorted(df)},
        "token_pattern": TOKEN, "stopwords": sorted(STOPWORDS),
    }
    return doc | {"profile_digest": S.digest(doc)}


def idf(df: int, n: int) -> float:
    return max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1.0))


def vector(text: str, p: dict) -> dict[str, float]:
    """The positive BM25 weights of a text's terms that the profile knows; an error under another tokenizer."""
    if p.get("token_pattern") != TOKEN or p.get("stopwords") != sorted(STOPWORDS):
        raise ValueError("the profile was made by another tokenizer")
    words = tokens(text)
    norm = p["k1"] * (1 - p["b"] + p["b"] * (len(words) / (p["avgdl"] or 1.0)))
    weights = {t: idf(p["df"][t], p["n_docs"]) * (f * (p["k1"] + 1)) / (f + norm) for t, f in Counter(words).items() if t in p["df"]}
    return {t: round(w, 6) for t, w in weights.items() if w > 0}


def unit(v: Mapping[str, float]) -> dict[str, float]:
    norm = math.sqrt(sum(w * w for w in v.values()))
    return {t: w / norm for t, w in v.items()} if norm else {}


def cosine(a: Mapping[str, float], b: Mapping[str, float]) -> float:
    """Of vectors of unit length."""
    return round(sum(w * b.get(t, 0.0) for t, w in sorted(a.items())), 6)


def claims(entry: str, text: str, p: dict, grammar: str = "term-grammar") -> list[dict]:
    """A relational triple for each term, its weight as a share of the largest."""
    v = vector(text, p)
    top = max(v.values(), default=1.0)
    of = {"profile_digest": p["profile_digest"], "grammar_id": grammar}
    return [{"s": entry, "p": "has_term", "o": t, "dimension": "relational", "weight": round(v[t] / top, 6), "provenance": of, "grammar_id": grammar} for t in sorted(v)]


def nd_system(namespace: str, profile_digest: str) -> dict:
    return S.nd_system("term-grammar", namespace, "term_weight", ontology=("term-vocabulary", profile_digest))


def descriptor(namespace: str, profile_digest: str) -> dict:
    return S.descriptor(nd_system(namespace, profile_digest), {"term_weight": "relational"})
