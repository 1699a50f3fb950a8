"""Decisions about candidates, recorded elsewhere and replayed by content.

What may be decided about a unit is a candidate set; its digest, with those of the instructions, the model and the prompt, is the key of a decision. A decision is looked up and never made here: a key without one
is an error. As tables, sets and decisions meet in a left join on the key (`decided`), decisions are appended once (`recorded`), and the manifest is their sorted digests.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import documents as D
from loomgraph.extract import build as B
from loomgraph.extract import outline as O
from loomgraph.extract import rules as R
from loomgraph.functions.text import LAYERS, PREDICATES

#: Versions that go into digests.
SCHEMA, SET_VERSION = "t3-hybrid-v1", "v2"
KEY_FIELDS = ("candidate_set_sha", "coder_view_sha", "model_id", "prompt_template_sha")
PROMPT = (
    "Code one unit of a legal text by the instructions below. You get its text, the instructions, and a set of candidates: spans of clauses, noun phrases, and statements that rules propose. Select the candidates that hold, "
    "each with its predicate, layer and negation, and correct a subject or an object only to a span of the set; add a statement that is missing only from such spans. Answer with one JSON object by the schema."
)


def canonical(doc) -> str:
    return json.dumps(doc, sort_keys=True, ensure_ascii=False, separators=(",", ": "))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class CacheMissError(KeyError):
    """No decision is recorded under a key."""


@dataclass(frozen=True)
class CandidateSet:
    unit_text: str
    enclosing_provision: str | None
    segments: tuple[dict, ...]
    np_chunks: tuple[dict, ...]
    candidates: tuple[dict, ...]
    extra_allowed_spans: tuple[dict, ...] = ()

    def as_dict(self) -> dict:
        return {"schema_version": SCHEMA, "candidate_set_version": SET_VERSION} | {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> CandidateSet:
        return cls(d["unit_text"], d.get("enclosing_provision"), *(tuple(d.get(k, ())) for k in ("segments", "np_chunks", "candidates", "extra_allowed_spans")))

    @property
    def sha256(self) -> str:
        return sha(canonical(self.as_dict()))


@dataclass(frozen=True)
class Decision:
    candidate_set_sha: str
    coder_view_sha: str
    model_id: str
    prompt_template_sha: str
    selections: tuple[dict, ...]
    added: tuple[dict, ...] = ()

    def as_dict(self) -> dict:
        return {"schema_version": SCHEMA} | {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> Decision:
        return cls(*(d[k] for k in KEY_FIELDS), tuple(d["selections"]), tuple(d.get("added", ())))

    @property
    def key(self) -> str:
        return key(*(getattr(self, k) for k in KEY_FIELDS))


def key(candidate_set_sha: str, coder_view_sha: str, model_id: str, prompt_template_sha: str) -> str:
    """The digest under which a decision is recorded."""
    return sha("|".join((candidate_set_sha, coder_view_sha, model_id, prompt_template_sha)))


def _span(s: Iterable[int]) -> dict:
    a, z = s
    return {"start": a, "end": z}


def propose(text: str, where: str | None = None) -> CandidateSet:
    """All that may be decided about a unit: outline, noun phrases, every candidate with its ends (again with the subject that its clause inherits or shares, where that differs), and further spans."""
    if not isinstance(text, str):
        raise ValueError("a unit is a text")
    nodes = O.outline(text)
    at = {(d["start"], d["end"]): k for k, d in enumerate(nodes)}
    inherited, tails, shared = O.inherited_subjects(text, nodes), O.antecedents(text, nodes), O.shared_subjects(text, nodes)
    out: list[dict] = []
    for c in R.unit_candidates(text, where):
        found = B.ends(text, c)
        if found is None:
            continue
        node = at.get(c.clause)
        explicit = inherited.get(node) or tails.get(c.clause) or shared.get(node)
        for subj, suffix in ((found[0], ""), (explicit, "-explicit-inherited-subj")):
            if subj and (not suffix or subj != found[0]):
                out.append({
                    "id": len(out), "rule_id": c.rule + suffix, "citation": c.rule, "predicate": c.predicate, "clause_span": list(c.clause), "subj_span": list(subj), "obj_span": list(found[1]),
                    "base_confidence": c.confidence, "negation_force": c.negation, "chapeau_group": c.group,
                })
    more = {*O.clean_noun_phrases(text), *O.conjuncts(text), *O.smallest_clauses(text, nodes), *inherited.values(), *tails, *tails.values(), *shared.values()}
    return CandidateSet(text, where, tuple(nodes), tuple(map(_span, O.noun_phrases(text))), tuple(out), tuple(map(_span, sorted(more))))


def allowed_spans(s: CandidateSet) -> set[tuple[int, int]]:
    named = {(x["start"], x["end"]) for x in (*s.segments, *s.np_chunks, *s.extra_allowed_spans)}
    return named | {tuple(c[k]) for c in s.candidates for k in ("clause_span", "subj_span", "obj_span") if c[k]}


# Decisions

_STATE = {"predicate": PREDICATES, "layer": LAYERS, "negation": D.NEGATIONS}
_SHAPES = {"selections": {"candidate_id", *_STATE, "subj_span_override", "obj_span_override"}, "added": {*_STATE, "subj_span", "obj_span"}}
#: The schema of a decision, for those who make it.
DECISION_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": [*KEY_FIELDS, "selections"],
    "properties": {"schema_version": {"type": "string"}} | {k: {"type": "string"} for k in KEY_FIELDS}
    | {name: {"type": "array", "items": {"type": "object", "additionalProperties": False, "properties": {f: {"enum": list(_STATE[f])} if f in _STATE else {"type": "integer"} if f == "candidate_id" else {"type": "array", "items": {"type": "integer"}} for f in sorted(fields)}}} for name, fields in _SHAPES.items()},
}


def decision_violations(d) -> list[str]:
    """What is wrong with the shape of a decision."""
    if not isinstance(d, dict):
        return ["a decision is a mapping"]
    out = [f"unknown field {k}" for k in sorted(set(d) - {"schema_version", *KEY_FIELDS, *_SHAPES})]
    out += [f"{k} is empty" for k in KEY_FIELDS if not isinstance(d.get(k), str) or not d[k]]
    for name, fields in _SHAPES.items():
        rows = d.get(name, [] if name == "added" else None)
        if not isinstance(rows, list):
            out.append(f"{name} is no list")
            continue
        for k, row in enumerate(rows):
            if not isinstance(row, dict):
                out.append(f"{name}[{k}] is no mapping")
                continue
            wrong = [f for f, known in _STATE.items() if not isinstance(row.get(f), str) or row[f] not in known]
            wrong += [f for f in ("subj_span", "obj_span") if name == "added" and not isinstance(row.get(f), list)]
            wrong += ["candidate_id"] * (name == "selections" and (not isinstance(row.get("candidate_id"), int) or isinstance(row.get("candidate_id"), bool)))
            out += [f"{name}[{k}].{f} is wrong" for f in wrong] + [f"{name}[{k}].{f} is unknown" for f in sorted(set(row) - fields)]
    return out


def read_decision(text: str, under: str) -> Decision:
    """A recorded decision, if it has the right shape and belongs under its key."""
    raw = json.loads(text)
    wrong = decision_violations(raw)
    if wrong:
        raise ValueError("; ".join(wrong))
    d = Decision.from_dict(raw)
    if d.key != under:
        raise ValueError(f"the decision under {under} is that of {d.key}")
    return d


class DecisionCache:
    """Decisions as files named by their keys, each written once."""

    def __init__(self, folder):
        self.folder = Path(folder)

    def record(self, under: str, decision: Decision) -> Path:
        text = canonical(decision.as_dict())
        read_decision(text, under)
        path = self.folder / f"{under}.json"
        if path.exists() and path.read_text(encoding="utf-8") != text:
            raise ValueError(f"{under} holds another decision")
        if not path.exists():
            self.folder.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return path

    def replay(self, under: str) -> Decision:
        path = self.folder / f"{under}.json"
        if not path.exists():
            raise CacheMissError(under)
        return read_decision(path.read_text(encoding="utf-8"), under)

    def _files(self) -> Iterator[Path]:
        return (p for p in sorted(self.folder.glob("*.json")) if re.fullmatch("[0-9a-f]{64}", p.stem))

    def manifest(self) -> dict[str, str]:
        return {p.stem: sha(p.read_text(encoding="utf-8")) for p in self._files()}

    def manifest_sha256(self) -> str:
        return sha(canonical(self.manifest()))

    def take_in(self, folder) -> list[Path]:
        """Records all decisions of a folder whose names are keys."""
        return [self.record(p.stem, read_decision(p.read_text(encoding="utf-8"), p.stem)) for p in DecisionCache(folder)._files()]


def decide(s: CandidateSet, view: str, model: str, prompt_sha: str, cache: DecisionCache) -> Decision:
    """The recorded decision about a candidate set; CacheMissError without one."""
    return cache.replay(key(s.sha256, sha(view), model, prompt_sha))


def assemble_with_spans(s: CandidateSet, decision: Decision, uri: str = "extracted-unit", date: str = "n/a") -> list[B.Built]:
    """The statements that a decision makes of a candidate set, in canonical order. An unknown or repeated candidate, a span that isn't of the set, and an invalid statement are errors."""
    if decision.candidate_set_sha != s.sha256 or not all(getattr(decision, k) for k in KEY_FIELDS):
        raise ValueError("the decision is of another candidate set")
    allowed, by_id, under, out = allowed_spans(s), {c["id"]: c for c in s.candidates}, decision.key, []
    chosen = [x["candidate_id"] for x in decision.selections]
    if len(set(chosen)) < len(chosen) or set(chosen) - set(by_id):
        raise ValueError("a candidate is unknown or selected twice")
    rows = [(x, by_id[x["candidate_id"]], by_id[x["candidate_id"]]["rule_id"]) for x in decision.selections] + [(x, x, "model-added") for x in decision.added]
    for row, base, rule in rows:
        subj, obj = (tuple(row.get(f"{end}_span_override") or base[f"{end}_span"]) for end in ("subj", "obj"))
        if not {subj, obj} <= allowed:
            raise ValueError(f"a span of {row} is not of the set")
        clause = base.get("clause_span") or (*subj, *obj)
        clause = min(*clause, *subj, *obj), max(*clause, *subj, *obj)
        ends = B.said(s.unit_text, subj), B.said(s.unit_text, obj)
        source = D.statement_text(f"{row['predicate']}|{ends[0]}|{ends[1]}|{clause[0]}-{clause[1]}|{under}")
        doc = {
            "id": D.statement_id(uri, date, D.statement_hash(source)), "subj": ends[0], "obj": ends[1], "predicate": row["predicate"], "dimension": PREDICATES[row["predicate"]], "layer": row["layer"], "weight": 1.0,
            "edge_confidence": 1.0, "provenance": {"start": clause[0], "end": clause[1]}, "negation": row["negation"], "extraction_rule_id": f"{rule}|model-decision:{under}",
        }
        if not D.is_valid("statement", doc):
            raise ValueError("; ".join(D.violations("statement", doc)))
        out.append(B.Built(doc, clause, subj, obj, base.get("chapeau_group")))
    return sorted(out, key=lambda b: D.statement_order(b.statement))


def assemble(s: CandidateSet, decision: Decision, **how) -> list[dict]:
    return [b.statement for b in assemble_with_spans(s, decision, **how)]


def export_requests(units: dict[str, dict], folder, view: str, model: str, prompt: str = PROMPT, mapping=None) -> list[Path]:
    """One request file for each unit (text, enclosing_provision), named by key, and beside the folder a file that maps units to keys."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    keys, paths = {}, []
    for name, u in units.items():
        s = propose(u["text"], u.get("enclosing_provision"))
        keys[name] = key(s.sha256, sha(view), model, sha(prompt))
        request = {
            "schema_version": SCHEMA, "candidate_set": s.as_dict(), "candidate_set_sha": s.sha256, "coder_view_text": view, "coder_view_sha": sha(view), "prompt_template": prompt, "prompt_template_sha": sha(prompt),
            "model_id": model, "cache_key": keys[name], "expected_output_schema": DECISION_SCHEMA,
        }
        paths.append(folder / f"{keys[name]}.json")
        paths[-1].write_text(canonical(request) + "\n", encoding="utf-8")
    Path(mapping or folder.parent / f"{folder.name}-mapping.json").write_text(canonical({"mapping": keys}) + "\n", encoding="utf-8")
    return paths


# As tables


def keyed(sets: DataFrame, view_sha: str, model: str, prompt_sha: str) -> DataFrame:
    """sets (candidate_set_sha, ...) with key."""
    return sets.withColumn("key", F.sha2(F.concat_ws("|", F.col("candidate_set_sha"), F.lit(view_sha), F.lit(model), F.lit(prompt_sha)).cast("binary"), 256))


def decided(sets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every set with its decision and a status: replayed, or missed."""
    return sets.join(decisions.select("key", "decision"), "key", "left").withColumn("status", F.when(F.col("decision").isNull(), "missed").otherwise("replayed"))


def recorded(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """The new decisions (key, decision) that are not recorded yet, each once, to be appended; other content under a known key is kept apart by `conflict`."""
    fresh = new.select("key", "decision").distinct()
    known = decisions.select("key", F.col("decision").alias("old"))
    return fresh.join(known, "key", "left").where("old IS NULL OR old <> decision").select("key", "decision", F.col("old").isNotNull().alias("conflict"))


def manifest(decisions: DataFrame) -> DataFrame:
    """key, sha256 of every recorded decision."""
    return decisions.select("key", F.sha2(F.col("decision").cast("binary"), 256).alias("sha256"))
