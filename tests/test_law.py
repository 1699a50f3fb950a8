import json
import os
import random
import re
from collections import Counter
from itertools import combinations, product
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from loomgraph import documents as D
from loomgraph import session
from loomgraph.extract import build as B
from loomgraph.extract import outline as O
from loomgraph.extract import references as X
from loomgraph.extract import replay as P
from loomgraph.extract import rules as R
from loomgraph.functions import citations as C
from loomgraph.functions import cues
from loomgraph.functions import lowering as L
from loomgraph.grammars import interplay, penalty, requirement, rulesets, term
from loomgraph.operators import evaluation as E
from loomgraph.operators import graph as G
from loomgraph.plans import law

#: Golden cases (JSON: input, expected), where a folder of them is named.
GOLDEN = os.environ.get("GOLDEN_CASES")


def golden(family):
    if not GOLDEN:
        return []
    return [pytest.param(json.loads(p.read_text()), id=f"{family}-{p.stem}") for p in sorted(Path(GOLDEN, family).glob("*.json"))]


def spans(text, nodes):
    return [(d["kind"], text[d["start"] : d["end"]], d["parent"], d["heir"]) for d in nodes]


# Outlines


def test_inline_list_with_tails_and_nested_items():
    t = "The provider shall: (a) keep a log; (b) inform — (i) the user; (ii) the board; and (c) act; the board may object; it is free."
    found = spans(t, O.outline(t))
    assert found[0][0] == "sentence" and found[1][:2] == ("chapeau", "The provider shall")
    assert ("list_item", "keep a log", 1, 1) in found and ("list_item", "the user", 4, 4) in found and ("list_item", "the board", 4, 4) in found
    assert found[3][:2] == ("list_item", "inform — (i) the user; (ii) the board") and found[4][:2] == ("chapeau", "inform")
    assert found[-1][:2] == ("list_item", "act")


def test_vertical_and_line_lists():
    t = "The controller shall provide:\n\n(a)\n\nthe purposes;\n\n(b)\n\nthe recipients, and shall say why.\n\nThe authority may act."
    kinds = [(k, s) for k, s, _, _ in spans(t, O.outline(t))]
    assert kinds[:2] == [("sentence", "The controller shall provide:\n\n(a)\n\nthe purposes;\n\n(b)\n\nthe recipients, and shall say why.\n\nThe authority may act"), ("chapeau", "The controller shall provide")] or kinds[1] == ("chapeau", "The controller shall provide")
    assert ("list_item", "the purposes") in kinds
    t = "The controller shall keep:\n(a) records of users;\n(b) records of events.\n"
    assert [(k, s) for k, s, _, _ in spans(t, O.outline(t))] == [("chapeau", "The controller shall keep"), ("list_item", "records of users"), ("list_item", "records of events")]


def test_clauses_headings_and_sentences():
    t = "29 1 Scope. The Board shall decide, which is final, and the Commission may object. See Art. 5 of the rules. A heading only."
    found = [(k, s) for k, s, _, _ in spans(t, O.outline(t))]
    assert ("clause", "The Board shall decide") in found and any(k == "clause" and s.startswith("the Commission may object") for k, s in found)
    assert not any("heading only" in s for _, s in found)
    assert O.outline("") == [] == O.outline(" \n") and O.outline("No verb here.") == []
    with pytest.raises(TypeError):
        O.outline(None)


def test_switches():
    t = "Where a breach occurs, the controller shall notify the authority."
    plain, split = O.outline(t), O.outline(t, O.Grammar().but(emit_sub_clause=True, emit_main_after_sub=True))
    assert len(split) == len(plain) + 2 and ("clause", "the controller shall notify the authority") in [(k, s) for k, s, _, _ in spans(t, split)]
    assert O.is_complete("The provider keeps a log") and not O.is_complete("The provider shall keep the following") and not O.is_complete("The provider shall inform the")


def test_noun_phrases_and_subjects():
    t = "The competent authority and the Board of Appeal shall inform the user of the decision."
    assert [t[a:b] for a, b in O.noun_phrases(t)][:2] == ["competent authority and the Board of Appeal", "user of the decision"]
    assert [t[a:b] for a, b in O.conjuncts(t)] == ["competent authority", "Board of Appeal"]
    t = "The Board shall decide, and shall publish the decision within 3 days."
    nodes = O.outline(t)
    assert {t[a:b] for a, b in O.shared_subjects(t, nodes).values()} == {"Board"}
    assert t[slice(*O.smallest_clause(t, (0, len(t))))] == "The Board shall decide, and shall publish the decision"
    t = "The Board shall: (a) keep a log; (b) act."
    assert {t[a:b] for a, b in O.inherited_subjects(t, O.outline(t)).values()} == {"Board"}


# Statements


@pytest.mark.parametrize(("text", "want"), [
    ("The supervisory authority shall have the power to carry out audits.", [("competence_of", "supervisory authority", "carry out audits", "absent")]),
    ("The user shall have the power to object.", [("performs", "user", "object", "absent")]),
    ("Point (a) shall not apply unless the user agrees.", [("except_when", "Point (a)", "user agrees", "present")]),
    ("The authority shall report annually to the Commission.", [("addressed_to", "report annually", "commission", "absent"), ("deadline_of", "report", "annually", "absent"), ("predication", None, None, None)]),
    ("This Regulation does not apply to users.", [("applies_to", "This Regulation", "users", "present")]),
])
def test_statements(text, want):
    found = [(s["predicate"], s["subj"], s["obj"], s["negation"]) for s in B.extract(text)]
    for w in want:
        assert w[1] is None or w in found, found
    assert all(D.is_valid("statement", s) for s in B.extract(text))


def test_deadlines_and_recipients():
    assert [R.deadline(x) for x in ("72 hours after the event", "at least once every two years", "every year", "by 2 May 2025", "without undue delay", "on a regular basis", "soon")] == ["72 hours", "every 2 years", "annually", "by 2 may 2025", "without undue delay", "regularly", "soon"]
    assert R.recipient("the competent supervisory authorities concerned") == "supervisory_authority" and R.recipient("its members referred to in Article 3") == "other(members)"
    assert R.without_deadline("delete the data within 3 days") == "delete the data" and R.without_deadline("within 3 days") == "within 3 days"


def test_negation_versions():
    assert B.negate("It may not act.", (0, 14), (0, 2), "performs") == "present" and B.negate("It acts. It does not.", (0, 7), (0, 2), "performs") == "uncertain"
    B.register_negation("always", lambda *a, force=None: "absent")
    assert B.negate("not", (0, 3), None, "performs", version="always") == "absent"
    with pytest.raises(ValueError):
        B.register_negation("always", None)
    with pytest.raises(KeyError):
        B.negate("x", None, None, "performs", version="none")


def test_items_inherit_the_trigger_of_their_chapeau():
    t = "The supervisory authority shall have the power to: (a) carry audits; (b) withdraw certificates."
    counts = Counter()
    found = B.extract_with_spans(t, counts=counts)
    assert [(b.statement["predicate"], b.statement["subj"], b.statement["obj"]) for b in found] == [("competence_of", "supervisory authority", "carry audits"), ("competence_of", "supervisory authority", "withdraw certificates")]
    assert all(b.statement["extraction_rule_id"].endswith(R.INHERITED) for b in found) and counts["candidates"] >= 2


def test_statements_of_whole_documents(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "The processor shall act.", "If A fails, B shall stop. " * 40, "plain prose without any cue " * 200])) for i in range(40)] + [(5, "The processor shall act.")] * 2 + [(None, "Users are part of groups.")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = sorted(repr((x.doc_id, x.id, x.subj, x.obj)) for x in law.documents_statements(spark, f"file://{tmp_path}").collect())
    assert found == sorted(repr((i, s["id"], s["subj"], s["obj"])) for i, t in rows for s in (B.extract(t, uri=law.URI, date=law.DATE) if t else []))


@pytest.mark.parametrize("case", golden("extractor"))
def test_golden_statements(case):
    assert B.extract(case["input"]["unit_text"]) == case["expected"]["statements"]


# Citations, headings, cues


def test_citations():
    assert C.targets("Articles 5 to 8 and Article 9(2), within Article 5 days, Article 3 of Directive 95/46/EC, Article 7 of Regulation (EU) 2016/679", 6, "2016/679") == [5, 7, 8, 9]
    assert C.numbers("Articles 1 to 99") == [1, 99]
    assert C.clause_point("Article 5 applies", {"dimension": "causal"}) == {"structural": 0.333333, "causal": 0.333333, "intentional": 0.0, "temporal": 0.0, "relational": 0.0}
    assert C.clause_point_from_profile("Article 5 applies", profile={"profile_id": "p", "clause_cue_saturation": 1})["structural"] == 1.0
    assert [x["o"] for x in C.links_from_profile("Articles 4 and 5", "s")] == ["Article 4", "Article 5"]
    for bad in (-1, True, float("nan")):
        with pytest.raises(ValueError):
            C.relational_effective(bad, 1)


def pins(text, **how):
    return [(r["kind"], r["external_instrument"], [t["pinpoint"] for t in r["targets"]] or r["external_target"]) for r in X.resolve(text, **how)]


def test_references_of_four_families():
    assert pins("Article 9(2), point (b), and Annex IV, point 2 apply.") == [("INTERNAL", None, ["Article 9(2), point (b)"]), ("INTERNAL", None, ["Annex IV, point 2"])]
    assert pins("See Schedule 2, paragraph 3(1) and Chapter 2 of Part 4.", family="uk") == [("INTERNAL", None, ["Schedule 2, paragraph 3(1)"]), ("INTERNAL", None, ["Part 4, Chapter 2"])]
    assert pins("sections 4 to 6 of this title", family="us", title="5 U.S.C.", sections={4, 5}) == [("INTERNAL", None, ["§ 4", "§ 5"]), ("EXTERNAL", "5 U.S.C.", "§ 6")]
    assert pins("§ 4 Abs. 2 Satz 1 des Handelsgesetzbuches", family="de") == [("EXTERNAL", "Handelsgesetzbuch", "§ 4 Abs. 2 Satz 1")]
    assert pins("paragraph 3, point (a), applies", unit="Article 7") == [("INTERNAL", None, ["Article 7(3), point (a)"])]
    assert pins("this Part and this Section", family="uk", units={"part": "Part 2"}) == [("INTERNAL", None, ["Part 2"]), ("INTERNAL", None, ["Section"])]


def test_references_that_point_back():
    assert pins("Directive 2002/58/EC applies. Article 5 thereof and Article 6 of that Directive bind.") == [("EXTERNAL", "Directive 2002/58/EC", None), ("EXTERNAL", "Directive 2002/58/EC", "Article 5"), ("EXTERNAL", "Directive 2002/58/EC", "Article 6")]
    assert pins("Article 6 of that Act binds.") == [("EXTERNAL", X.UNNAMED, "Article 6")] and pins("thereof nothing") == []
    assert pins("Article 4 applies. That Article binds; that Article 5 too.")[:2] == [("INTERNAL", None, ["Article 4"]), ("INTERNAL", None, ["Article 4"])]
    assert pins("Article 5 of the Data Act 2018 and the Data Act 2018", host_name="Data Act 2018") == [("INTERNAL", None, ["Article 5"]), ("INTERNAL", None, [X.HOST])]
    assert X.objects(X.resolve("Article 5 and Article 5 of Directive 95/46/EC")) == ["Article 5", "Directive 95/46/EC|Article 5"] and X.last_instrument("Directive 95/46/EC and title 5") == "5 U.S.C."
    assert "hard_case_tags" in X.resolve("paragraph 4 (so in original)")[0] and X.resolve("[Article 5 so in original]") == []


@pytest.mark.parametrize("case", [c for c in golden("clause-cues") if "references" in c.values[0]["expected"]])
def test_golden_references(case):
    names = {"enclosing_unit": "unit", "numbering_family": "family", "host_instrument_name": "host_name", "host_instrument_number": "host_number", "whole_host_unit": "whole", "preceding_text": "before", "quoted_amending_target": "amended", "enclosing_units": "units", "host_title_instrument": "title", "host_section_numbers": "sections"}
    assert X.resolve(case["input"]["text"], **{names[k]: v for k, v in case["input"].items() if k in names}) == case["expected"]["references"]


def test_headings():
    t = "PART 1\nx\nCHAPTER 2\ny\nPART 3\nz\nSCHEDULE 1\nw\nPART 2\nv"
    at = lambda c: t.index(c)
    assert C.enclosing_units(t, at("y"), "uk") == {"part": "Part 1", "chapter": "Chapter 2"} and C.enclosing_units(t, at("z"), "uk") == {"part": "Part 3"}
    assert C.enclosing_units(t, at("v"), "uk") == {"schedule": "Schedule 1", "part": "Part 2"} and C.enclosing_unit(t, at("v"), "uk") == "Part 2"
    assert C.enclosing_unit("Article 5\n\ntext", 0) is None and C.own_sections("§ 12a. A § 3. B") == {"12", "3"}


def test_cue_runs_equal_a_mask():
    r = random.Random(4)
    words = "if where leads to risk within 3 days period purpose of in order to ensure referred to in paragraph 2 right to".split()
    for _ in range(200):
        t = " ".join(r.choice(words) for _ in range(30))
        for d, patterns in cues.COMPILED.items():
            mask = [0] * (len(t) + 1)
            starts = set()
            for a, z in (m.span() for p in patterns for m in p.finditer(t)):
                starts.add(a)
                mask[a:z] = [1] * (z - a)
            gaps = sum(1 for k in range(len(t)) if mask[k] and (k == 0 or not mask[k - 1]))
            assert cues.runs(t, patterns) == gaps == cues.counts(t)[d], (t, d)


def test_cue_letters_are_what_a_match_must_hold():
    for t in ("İF", "ıf", "cauſe", "CAUSED", "RIſK", "Where", "K", "Straße if", "within 3 DAYS", "‘x’ MEANS"):
        assert cues.counts(t) == {d: cues.runs(t, p) for d, p in cues.COMPILED.items()}, t
    assert all(n for found in cues.NEEDLES.values() for n in found)


@pytest.mark.parametrize("case", golden("assertoric-lowering"))
def test_golden_links(case):
    want = case["expected"].get("result", case["expected"]) if case["expected"] else None
    found = L.lower(case["input"]["sentence"])
    assert (found and found | {"canonical": found["canonical"] and list(found["canonical"])}) == want


def test_links_abstain():
    assert L.lower("Nothing to say") is None and L.lower("The user must") is None
    with pytest.raises(ValueError):
        L.lower(" ")
    assert L.lower("The Board knows that a user is part of the group.")["subject"] == "user"


# Grammars


def test_concepts_against_plain_sentences(spark, tmp_path):
    r = random.Random(8)
    parts = ["profiling is completed", "no human review is offered", "the user may contest the decision", "he may not contest the decision", "plain words", "a person reviews it without undue delay"]
    rows = [(i, ". ".join(p.capitalize() for p in r.choices(parts, k=r.randrange(6))) + "." if r.random() < 0.9 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = set()
    for i, t in rows:
        said = Counter()
        for s in (t or "").split("."):
            for c, patterns in requirement.CONCEPTS.items():
                if any(re.search(p, s, re.I) for p in patterns):
                    said[c] = max(said[c], 1 if re.search(r"\b(?:no|not)\b", s, re.I) else 2)
        want |= {(i, c, v == 2) for c, v in said.items() if v}
    assert {(x.doc_id, x.concept, x.affirmed) for x in law.documents_concepts(spark, f"file://{tmp_path}").collect()} == want


def test_obligations():
    doc = {"ruleset_id": "r", "rules": [{"obligation_id": "o", "citation": "c", "trigger_concepts": ["automated_decision_making"], "required_concepts": ["human_intervention", "right_to_contest"]}]}
    found = requirement.check("o", ["Profiling is done.", "There is no human review."], doc)
    assert (found["triggered"], found["uncertain"], found["missing"], found["all_present"], found["needs_review"]) == (True, ["human_intervention"], ["right_to_contest"], False, True)
    assert requirement.check("o", [], doc)["all_present"] is None and requirement.present(["Profiling is done."]) == {"automated_decision_making"}
    assert requirement.affirmed("The right not to be subject to profiling") == {"automated_decision_making"} and requirement.matched("No profiling") == {"automated_decision_making"}
    with pytest.raises(KeyError):
        requirement.check("x", [], doc)
    with pytest.raises(ValueError):
        requirement.check("o", "one text", doc)
    assert requirement.ruleset_violations({"ruleset_id": "", "rules": [{"obligation_id": "o", "citation": "c", "trigger_concepts": ["x"], "required_concepts": []}]}) and requirement.ruleset_violations([])
    assert requirement.ruleset_digest(doc) != requirement.ruleset_digest(doc | {"ruleset_id": "s"})


def test_interplay():
    text = "This is without prejudice to Article 5 of Directive 2002/58/EC and to (EU) 2016/679. It is without prejudice to paragraph 2."
    found = interplay.relations([{"instrument_id": "gdpr", "article_id": "gdpr:1", "text": text}], law.INTERPLAY)
    assert [(r["target_instrument"], r["target_article"], r["confidence"], r["unresolved"]) for r in found] == [("eprivacy", "5", 0.9, False), ("external:directive-eu-2016-679", None, 0.9, False), (None, None, 0.54, True)]
    assert interplay.triple(found[0])["o"] == "eprivacy:5"
    with pytest.raises(ValueError):
        interplay.triples(found)
    assert len(interplay.triples(found[:2])) == 2
    assert interplay.authority_violations({"source_instrument": "a", "target_instrument": "b", "relation": "cumulative", "basis": "authority", "authority": {"name": "n", "locator": "l"}}) == []
    assert len(interplay.authority_violations({})) == 5
    assert D.is_valid("descriptor", interplay.descriptor("org.example.interplay")) and D.is_valid("descriptor", penalty.descriptor("org.example.penalty")) and D.is_valid("descriptor", term.descriptor("org.example.term", "d"))
    assert interplay.ruleset_violations({"ruleset_id": "r", "cues": [{"cue_id": "c", "trigger_pattern": "(", "relation": "x", "target_mode": "y", "max_span_chars": 0, "confidence": 2}]}).__len__() == 5


def test_penalties():
    text = "4. Infringements of the following provisions shall, other than Article 9, be subject to administrative fines up to 10 000 000 EUR, or up to 2,5 % of the total worldwide annual turnover, whichever is higher: Articles 8, 11, (3), 25 to 27 and 9."
    (r,) = penalty.penalties([{"instrument_id": "gdpr", "article_id": "Art.83", "text": text}], law.PENALTY)
    assert (r["paragraph"], r["fixed_amount_eur"], r["turnover_percentage"], r["turnover_basis"], r["bound_type"], r["combination_rule"]) == ("4", 10_000_000, 2.5, "total worldwide annual turnover", "ceiling", "whichever_is_higher")
    assert r["infringed_provisions"] == ["8", "11", "11(3)", "25 to 27"] and r["excluded_provisions"] == ["9"] and not r["unresolved"]
    assert [t["s"] for t in penalty.triples(r)] == [f"gdpr:Art.{n}" for n in (8, 11, 25, 26, 27)] and penalty.node(r) == "Art.83(4):administrative_fine"
    assert penalty.amount("a fine of twenty five thousand euros") == 25_000 and penalty.amount("two hundred and five euros") == 205 and penalty.amount("none") is None
    assert penalty.provisions("Chapters IV and V, Article 3", 0, 28) == ["Chapter IV", "Chapter V", "3"] and penalty.nodes("x", "Chapter IV") == ["x:Chapter.IV"]
    with pytest.raises(ValueError):
        penalty.penalties([{"instrument_id": "a", "article_id": "b", "text": "administrative fines without end"}], law.PENALTY)
    with pytest.raises(ValueError):
        penalty.authority_triples({})
    sound = {"source_instrument": "a", "source_article": "b", "penalty_kind": "penalty", "basis": "authority", "authority": {"name": "n", "locator": "l"}, "infringed_provisions": ["4"]}
    assert penalty.authority_triples(sound)[0]["s"] == "a:Art.4"


def test_term_profiles(tmp_path):
    p = term.profile({"a": "alpha beta", "b": "beta gamma gamma"})
    assert p["df"] == {"alpha": 1, "beta": 2, "gamma": 1} and p["avgdl"] == 2.5
    v = term.unit(term.vector("gamma alpha", p))
    assert term.cosine(v, v) == 1.0 and term.vector("delta", p) == {} and term.unit({}) == {}
    claims = term.claims("e", "gamma gamma alpha", p)
    assert [c["o"] for c in claims] == ["alpha", "gamma"] and max(c["weight"] for c in claims) == 1.0 and all(D.is_valid("triple", c) for c in claims)
    with pytest.raises(ValueError):
        term.vector("x", p | {"token_pattern": "."})
    (tmp_path / "r.json").write_text(json.dumps(law.PENALTY))
    assert rulesets.load(tmp_path / "r.json") == law.PENALTY


# Documents


def test_sound_documents():
    s = B.extract("The processor shall act.")[0]
    system = {"id": "s", "namespace": "n", "version": 1, "axes": {"a": None}}
    doc = {"plane": "p", "language_version": "1", "nd_system": {"nd_system": system}, "binding": {"r": "causal"}, "contract_version": "1.0-draft", "co_dimensions": ["a"]}
    for kind, d in (("statement", s), ("nd_system", system), ("descriptor", doc), ("link", {"dimension": "structural", "relation": "Em-Beds"}), ("embeds_link", {"dimension": "structural", "relation": "embeds"}), ("point", dict.fromkeys(D.DIMENSIONS, 0.5)),
                    ("view", D.make_view(1, "position", ["b", "a"], [], "d", "b", "erasure")), ("triple", {"s": "a", "p": "b", "o": "c", "dimension": "causal", "provenance": None}), ("reference", {"dimensions": ["causal"], "anchor": "u#1-2"}), ("profile", {"profile_id": "p"})):
        assert D.violations(kind, d) == [], kind
        for wrong in (None, [], "x", {}):
            assert D.violations(kind, wrong), kind
    assert D.violations("descriptor", doc, runtime=True) == ["lacks produce"]
    assert D.is_fenced({"stale": True, "staleness_tier": "erasure"}) and D.same_after_erasure({"value": 1}, {"value": 1}) and D.member_digest(["b", "a"], 1) == D.member_digest(["a", "b"], 1)
    c, i = s | {"predicate": "requires", "dimension": "causal", "obj": "m"}, s | {"predicate": "based_on", "dimension": "intentional", "subj": "m"}
    assert D.violations("dual_split", {"causal": c, "intentional": i}) == [] and D.violations("dual_split", {"causal": c, "intentional": i | {"subj": "n"}}) == ["no shared middle"]
    assert D.statement_text("é \xa0 x\n") == "\xe9 x" and D.digest({"b": 1, "a": "é"}) == D.digest({"a": "é", "b": 1})
    for bad in ("x", "0123"):
        with pytest.raises(ValueError):
            D.statement_id("u", "d", bad)


def test_checks_never_raise():
    r = random.Random(1)
    junk = [None, True, 0, -1, 1.5, float("nan"), "", "x", [], ["a"], {}, {"a": 1}, [[]], {"id": []}]
    keys = ["id", "axes", "version", "namespace", "bindings", "nd_system", "plane", "binding", "co_dimensions", "examples", "contract_version", "dimension", "relation", "weight", "provenance", "kind", "stale", "dimensions", "anchor", "k", "predicate", "layer", "vocabulary", "primitives", "validation", "causal", "intentional", "r"]
    for _ in range(600):
        doc = {k: r.choice([*junk, {k2: r.choice(junk) for k2 in r.sample(keys, 3)}]) for k in r.sample(keys, r.randrange(1, 9))}
        for kind in D.CHECKS:
            assert isinstance(D.violations(kind, doc), list)


@pytest.mark.parametrize(("family", "kind"), [("nd-system", "nd_system"), ("statement", "statement"), ("triple", "triple"), ("resolution-profile", "profile"), ("descriptor-binding", "descriptor")])
def test_golden_documents(family, kind):
    for p in golden(family):
        (case,) = p.values
        i, want = case["input"], case["expected"].get("valid")
        if want is not None:
            assert D.is_valid(kind, i.get("doc", i.get("descriptor")), **({"runtime": True} if i.get("require_produce") else {})) == want, p.id


# Replay


UNIT = "The controller shall: (a) keep a record; (b) inform the data subject within 3 days. The authority may act, and shall decide."


def decision(s, **more):
    c = s.candidates[0]
    base = {"candidate_id": 0, "predicate": c["predicate"], "layer": "domain", "negation": "absent"}
    return P.Decision(s.sha256, P.sha("view"), "model", P.sha("prompt"), (base | more,))


def test_decisions_are_replayed_by_content(tmp_path):
    s = P.propose(UNIT)
    assert P.CandidateSet.from_dict(json.loads(P.canonical(s.as_dict()))).sha256 == s.sha256 != P.propose(UNIT + " ").sha256
    d, cache = decision(s), P.DecisionCache(tmp_path / "c")
    with pytest.raises(P.CacheMissError):
        P.decide(s, "view", "model", P.sha("prompt"), cache)
    cache.record(d.key, d)
    cache.record(d.key, d)
    assert P.decide(s, "view", "model", P.sha("prompt"), cache) == d
    (found,) = P.assemble(s, d)
    assert found["edge_confidence"] == 1.0 and found["extraction_rule_id"].endswith(d.key) and D.is_valid("statement", found)
    other = decision(s, layer="deep")
    assert other.key == d.key
    with pytest.raises(ValueError):
        cache.record(d.key, other)
    with pytest.raises(ValueError):
        cache.record("0" * 64, d)
    for bad in (decision(s, candidate_id=999), decision(s, subj_span_override=[0, 2])):
        with pytest.raises(ValueError):
            P.assemble(s, bad)
    added = P.Decision(s.sha256, "v", "m", "p", (), ({"predicate": "performs", "layer": "domain", "negation": "absent", "subj_span": s.candidates[0]["subj_span"], "obj_span": s.candidates[0]["obj_span"]},))
    assert P.assemble(s, added)[0]["extraction_rule_id"].startswith("model-added")
    assert P.decision_violations({"x": 1, "selections": [{"candidate_id": True}], "added": 3})
    again = P.DecisionCache(tmp_path / "d")
    assert len(again.take_in(tmp_path / "c")) == 1 and again.manifest_sha256() == cache.manifest_sha256()
    (path,) = P.export_requests({"u": {"text": UNIT}}, tmp_path / "out", "view", "model", "prompt")
    assert path.stem == d.key and json.loads((tmp_path / "out-mapping.json").read_text())["mapping"] == {"u": d.key}


def test_replay_as_tables(spark, tmp_path):
    from loomgraph.sources import files

    s = P.propose(UNIT)
    d = decision(s)
    P.DecisionCache(tmp_path / "c").record(d.key, d)
    (tmp_path / "c" / "notes.json").write_text("{}")
    found = files.read_decisions(spark, f"file://{tmp_path}/c")
    assert [(r.key, r.decision) for r in found.collect()] == [(d.key, P.canonical(d.as_dict()))]
    sets = files.candidate_sets(spark.createDataFrame([("u", UNIT), ("v", "Other text shall be."), ("w", None)], "unit string, text string"))
    mapping = files.write_requests(sets, f"file://{tmp_path}/requests", "view", "model", "prompt")
    assert {r.unit: r.key for r in mapping.collect()}["u"] == d.key
    joined = {r.unit: r.status for r in P.decided(P.keyed(sets, P.sha("view"), "model", P.sha("prompt")), found).collect()}
    assert joined == {"u": "replayed", "v": "missed", "w": "missed"}
    new = spark.createDataFrame([(d.key, "other"), ("k", "x"), ("k", "x")], "key string, decision string")
    assert {(r.key, r.conflict) for r in P.recorded(found, new).collect()} == {(d.key, True), ("k", False)}
    units = files.read_units(spark, f"file://{tmp_path}/c/notes.json")
    assert [r.text for r in units.collect()] == ["{}"] and files.read_ruleset(spark, f"file://{tmp_path}/c/notes.json") == {}
    rows = spark.createDataFrame([(1, UNIT, "u", "d")], "n int, text string, uri string, date string")
    files.write_statements(B.statements(rows, "text", "uri", "date").drop("text"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("dimension = 'temporal'").count() == 1


# Sessions


def test_functions_in_sql(spark):
    names = session.register(spark)
    assert "extract_statements" in names
    one = lambda q: spark.sql(q).first()[0]
    assert one("SELECT dim_compose('causal', 'structural')") == "causal" and one("SELECT dim_compose('causal', 'x')") is None and one("SELECT to_fixed(-0.0000015D)") == -2 and one("SELECT relation_key(' Em-Beds ')") == "embeds"
    assert one("SELECT lower_assertion('Step 1 precedes step 2').relation") == "precedes" and one("SELECT size(document_violations('point', '{}'))") == 1
    rows = spark.sql("SELECT predicate, subj FROM VALUES ('The processor shall act.', 'u', 'd') t(x, u, d), LATERAL extract_statements(x, u, d, NULL)").collect()
    assert [tuple(r) for r in rows] == [("performs", "processor")]
    assert spark.sql("SELECT kind FROM outline('The processor shall act.')").count() == 2
    assert spark.sql("SELECT instrument FROM instrument_citations('Regulation (EU) 2016/679')").first()[0] == "gdpr"
    assert spark.sql(f"SELECT target_instrument FROM interplay_relations('a', 'b', 'without prejudice to Directive 2002/58/EC.', '{json.dumps(law.INTERPLAY)}')").first()[0] == "eprivacy"
    assert spark.sql("SELECT name FROM headings('PART 1', 'uk')").first()[0] == "Part 1"


def test_planes_bring_their_own_claims(spark):
    system = {"id": "s", "namespace": "n", "version": "1", "axes": {"a": {}}}
    doc = {"plane": "my-plane", "language_version": "1", "nd_system": system, "binding": {"says": "relational"}, "contract_version": "1.0-draft", "produce": lambda sentence, context: [{"s": w, "p": "says", "o": context.get("o", "x"), "dimension": "relational"} for w in sentence.split()]}
    name = session.register_plane(spark, doc)
    assert [r.s for r in spark.sql(f"SELECT * FROM {name}('a b', '{{\"o\": \"y\"}}')").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        session.register_plane(spark, {k: v for k, v in doc.items() if k != "produce"})


# Evaluation, graphs


def test_sign_flip_equals_enumeration():
    r = random.Random(3)
    for n in (1, 5, 9):
        d = [r.randrange(-3, 4) * 100_000 for _ in range(n)]
        want = sum(sum(s * abs(x) for s, x in zip(signs, d, strict=True)) >= sum(d) for signs in product((1, -1), repeat=n))
        assert E.sign_flip(d) == (want, 2**n)
    with pytest.raises(ValueError):
        E.sign_flip([1] * 41)


def test_span_scores_equal_greedy_matching(spark):
    r = random.Random(6)
    draw = lambda: [(u, a, a + r.randrange(1, 9)) for u in range(20) for a in r.sample(range(60), r.randrange(6))]
    found, gold = draw(), draw()
    matched = 0
    for u in range(20):
        f, g = sorted((a, z) for w, a, z in found if w == u), sorted((a, z) for w, a, z in gold if w == u)
        while True:
            best = max(((min(x[1], y[1]) - max(x[0], y[0]), [-v for v in x], [-v for v in y], x, y) for x in f for y in g), default=None, key=lambda b: b[:3])
            if best is None or best[0] <= 0:
                break
            f.remove(best[3])
            g.remove(best[4])
            matched += 1
    df = lambda rows: spark.createDataFrame(rows, "unit int, start int, end int")
    (row,) = E.span_scores(df(found), df(gold), "unit").collect()
    assert (row.matched, row.found, row.gold) == (matched, len(found), len(gold)) and row.f1 == round(2e6 * matched / (len(found) + len(gold)))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_quantiles_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr("loomgraph.operators.order.CHUNK", chunk)
    r = random.Random(7)
    rows = [(g, i, float(r.choice([1, 2, 2.5, 9, r.random() * 50]))) for i in range(300) for g in [r.choice(["hot", "hot", "b"])]] + [("single", 999, 3.0)]
    found = {x.i: x.quantile for x in G.quantiles(spark.createDataFrame(rows, "g string, i int, v double"), "g", "v").collect()}
    for g, i, v in rows:
        others = [w for h, _, w in rows if h == g]
        want = sum(w < v for w in others) / (len(others) - 1) if len(others) > 1 else 0.0
        assert abs(found[i] - want) < 1e-12


def test_top_k_and_paths_refuse_bad_input(spark):
    rows = [("c", f"m{i}", float(i % 3)) for i in range(7)] + [("d", "x", 1.0)]
    df = spark.createDataFrame(rows, "c string, m string, w double")
    for k, n_min in ((2, 3), (1, 5), (9, 2)):
        want = []
        for c in ("c", "d"):
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], __import__("hashlib").sha256(f"s|{r[1]}".encode()).hexdigest()))
            want += [(c, r[1]) for r in (own if len(own) < n_min else own[:k])]
        assert sorted((x.c, x.m) for x in G.trimmed_top_k(df, "c", "m", "w", k, n_min, "s").collect()) == sorted(want)
    with pytest.raises(ValueError):
        G.typed_path_search(spark.createDataFrame([("a", "b", "causal", 1.5)], "source string, target string, dimension string, weight double"), "a")


def test_citation_signals_against_pairs(spark):
    r = random.Random(9)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(50)}
    pairs = list(combinations(range(12), 2))
    found = E.citation_signals(spark.createDataFrame(list(edges), "src int, dst int"), spark.createDataFrame(pairs, "a int, b int")).collect()
    src, dst = (lambda n: {d for s, d in edges if s == n}), (lambda n: {s for s, d in edges if d == n})
    assert {(x.a, x.b): (x.direct, x.cocitation, x.coupling) for x in found} == {(a, b): (((a, b) in edges) + ((b, a) in edges), len(dst(a) & dst(b)), len(src(a) & src(b))) for a, b in pairs}


# Folds and nesting


def test_digests_stream_groups(spark):
    from loomgraph.operators import folds, windows

    r = random.Random(15)
    rows = [(r.choice([None, "a", "hot"]), r.choice(["x", "é", 'q"', "y1", "y10", "y2"])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, m string").repartition(4)
    of = lambda g: [m for h, m in rows if h == g]
    assert {x.g: x.digest for x in folds.member_digests(df, "g", "m", 3).collect()} == {g: D.member_digest(set(of(g)), 3) for g in (None, "a", "hot")}
    plain = spark.createDataFrame([(g, m) for g, m in rows if m.isascii() and '"' not in m], "g string, m string")
    for few in (0, 3, 4096):  # streamed, some of each, as arrays
        got = folds.digests(plain.select("g", F.lit(0).alias("section"), F.col("m").alias("member")).distinct(), "g", ["members"], '"version":3', few)
        assert {x.g: x.digest for x in got.collect()} == {g: D.member_digest({m for m in of(g) if m.isascii() and '"' not in m}, 3) for g in (None, "a", "hot")}
    held = spark.createDataFrame([("hot", "n"), ("other", "k")], "g string, m string")
    found = {x.g: x.digest for x in folds.position_digests(df, held, "g", "m", "p").collect()}
    assert found["hot"] == D.position_digest(of("hot"), ["n"], "p") and found["other"] == D.position_digest([], ["k"], "p") and found[None] == D.position_digest(of(None), [], "p")
    times = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 3, 4, 100)] + [("b", 5.0)], "n string, t double")
    assert {x.n: x.flushes for x in windows.debounced(times, "n", "t", 10.0, 5).collect()} == {"a": 2, "b": 1}
    assert windows.debounced(times.limit(0), "n", "t", 10.0, 5).count() == 0
    with pytest.raises(ValueError):
        windows.debounced(times, "n", "t", 1.0, 0)


def test_nesting_against_plain_search():
    from loomgraph.operators.nesting import Nesting

    r = random.Random(13)
    dag, edges = Nesting(), set()
    for _ in range(600):
        a, b = (f"n{r.randrange(40)}" for _ in range(2))
        below, stack = set(), [b]
        while stack:
            n = stack.pop()
            if n not in below:
                below.add(n)
                stack += [y for x, y in edges if x == n]
        held = dag.copy()
        assert dag.would_cycle(a, b) == (a in below)
        if a in below:
            with pytest.raises(G.CycleError):
                dag.add(a, b)
            assert (dag.place, dag.below, dag.above) == (held.place, held.below, held.above)
        else:
            dag.add(a, b)
            edges.add((a, b))
        assert all(dag.place[x] < dag.place[y] for x, y in edges) and len(set(dag.place.values())) == len(dag.place)
    assert {(x, y) for x, ys in dag.below.items() for y in ys} == edges == {(x, y) for y, xs in dag.containers().items() for x in xs}


@pytest.mark.parametrize("case", golden("cycle-rejection"))
def test_golden_nesting(case):
    from loomgraph.operators.nesting import Nesting

    i, want = case["input"], case["expected"]
    dag = Nesting(map(tuple, i["existing_edges"]))
    if "error" in want:
        with pytest.raises(G.CycleError):
            dag.add(*i["add_edge"])
    else:
        dag.add(*i["add_edge"])
        assert dag.place == want.get("order", dag.place) and sorted(dag.below[i["add_edge"][0]]) == sorted(want.get("children_of_parent", dag.below[i["add_edge"][0]]))


def test_references_that_must_resolve(spark):
    from loomgraph.operators import retrieval as Q

    refs = lambda *rows: spark.createDataFrame(list(rows), "ref_id int, ref string, source_text string")
    entries = spark.createDataFrame([("u#2-5", "cde"), ("u#0-2", "xy")], "ref string, text string")
    assert [r.text for r in Q.resolved_or_raise(refs((1, "u#2-5", "abcdefg")), entries).collect()] == ["cde"]
    for row, error in (((1, None, None), Q.MalformedReferenceError), ((1, "u#2-6", None), Q.UnknownReferenceError), ((1, "u#0-2", "abc"), Q.SpanMismatchError)):
        with pytest.raises(error):
            Q.resolved_or_raise(refs(row), entries)
    with pytest.raises(Q.MissingStoreError):
        Q.resolved_or_raise(refs((1, "u#2-5", None)), None)
    tampered = spark.createDataFrame([("u#2-5", "cde", "x")], "ref string, text string, digest string")
    asked = spark.createDataFrame([(1, "u#2-5", "y")], "ref_id int, ref string, expected_digest string")
    assert Q.resolve_references(asked, tampered).first().status == "span_mismatch"


def test_references_of_whole_documents(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, r.choice([None, "", "Article 5 applies. ", "See Directive 95/46/EC, Article 3 thereof and § 4 Abs. 2. ", "plain words " * 300]) and "Article 5 applies. " * r.randrange(1, 9)) for i in range(30)] + [(None, "Annex IV"), (3, "Schedule 2"), (3, "Schedule 2")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = sorted(repr((x.doc_id, x.kind, x.instrument, x.pinpoints, x.start)) for x in law.documents_references(spark, f"file://{tmp_path}").collect())
    want = [(i, x["kind"], x["external_instrument"], ", ".join(t["pinpoint"] for t in x["targets"]) or x.get("external_target"), x["literal_start"]) for i, t in rows if t for x in X.resolve(t)]
    assert found == sorted(map(repr, want)) and len(found) > 50


def test_python_work_is_dealt_by_rows_not_by_pieces_of_a_scan(spark, tmp_path):
    from loomgraph.sources.tables import dealt

    for k, n in enumerate((2000, 1, 1, 1, 1, 1)):  # six pieces, of which one has nearly all rows
        spark.range(10_000 * k, 10_000 * k + n, 1, 1).write.mode("append").parquet(str(tmp_path / "t"))
    df = dealt(spark.read.parquet(str(tmp_path / "t")), "id")
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2005 and max(sizes) < 2 * 2005 / len(sizes) and len(sizes) >= spark.sparkContext.defaultParallelism


def test_lazy_subjects_are_tried_only_before_their_core():
    import time

    from loomgraph.extract import rules

    text = "word " * 20_000 + "shall be. " + "The unit is part of the group unless the user objects to it."
    for _, cues in rules.FAMILIES:
        for cue in cues:
            sample = text[-400:]
            assert [m.span() for m in rules._matches(cue, sample)] == [m.span() for m in cue.pattern.finditer(sample)]
    cue = next(c for _, cues in rules.FAMILIES for c in cues if c.rule.endswith("except_when-unless"))
    started = time.perf_counter()
    fast = [m.span() for m in rules._matches(cue, text)]
    middle = time.perf_counter()
    assert fast == [m.span() for m in cue.pattern.finditer(text)]
    assert (middle - started) * 5 < time.perf_counter() - middle


def test_sentences_that_come_again_are_read_once_unless_their_unit_counts(monkeypatch):
    from loomgraph.extract import references

    texts = ["Article 5(2) of this Regulation applies.", "point (b) applies."] * 20
    units = [f"Article {k}" for k in range(40)]
    want, reads = [references.resolve(t, unit=u) for t, u in zip(texts, units, strict=True)], []
    read = references._Reader.read
    monkeypatch.setattr(references._Reader, "read", lambda self: reads.append(1) or read(self))
    assert references.resolved(texts, units) == want and len(reads) == 21
