"""Rules over concept states, joins of statements, nesting neighbourhoods and batch writes to a containment graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.operators import graph as G
from loomgraph.operators.graph import CycleError  # noqa: F401
from loomgraph.operators.topology import levels
from loomgraph.profile import resolve_profile
from loomgraph.sources.tables import stored

#: Bytes of the rules that pair with every entity at most: they go to all tasks.
MOST_RULE_BYTES = 16 << 20


def concept_states(tags: DataFrame, entity: str) -> DataFrame:
    """tags (entity, concept, affirmed) to (entity, concept, state): present if affirmed anywhere, else uncertain. What has no row is absent."""
    return tags.groupBy(entity, "concept").agg(F.max("affirmed").alias("a")).select(entity, "concept", F.when(F.col("a"), "present").otherwise("uncertain").alias("state"))


def check_requirements(entities: DataFrame, entity: str, states: DataFrame, rules: DataFrame) -> DataFrame:
    """Every entity with every rule (obligation_id, trigger_concepts, required_concepts): triggered, trigger_uncertain, present, uncertain, missing, all_present (NULL unless
    triggered), needs_review. Rules are a small document and pair with each row; an entity's concepts come from a closed vocabulary, so their map is small."""
    size = rules.agg(F.sum(F.octet_length("obligation_id") + F.octet_length(F.concat_ws(",", "trigger_concepts", "required_concepts")) + 64)).first()[0] or 0
    if size > MOST_RULE_BYTES:
        raise ValueError(f"the rules take over {MOST_RULE_BYTES} bytes: check them in parts")
    rules = F.broadcast(rules)
    held = states.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("concept", "state"))).alias("of"))
    rows = entities.select(entity).join(held, entity, "left").withColumn("of", F.coalesce("of", F.expr("cast(map() as map<string,string>)")))

    def having(concepts: str, state: str):
        return F.array_sort(F.filter(concepts, lambda c: F.coalesce(F.try_element_at("of", c), F.lit("absent")) == state))

    found = rows.crossJoin(rules).select(
        entity, "obligation_id", (F.size(having("trigger_concepts", "present")) > 0).alias("triggered"), (F.size(having("trigger_concepts", "uncertain")) > 0).alias("maybe"),
        having("required_concepts", "present").alias("present"), having("required_concepts", "uncertain").alias("uncertain"), having("required_concepts", "absent").alias("missing"),
    )
    found = found.withColumn("trigger_uncertain", ~F.col("triggered") & F.col("maybe")).drop("maybe")
    whole = (F.size("uncertain") == 0) & (F.size("missing") == 0)
    return found.withColumns({"all_present": F.when(F.col("triggered"), whole), "needs_review": (F.size("uncertain") > 0) | F.col("trigger_uncertain")})


def dual_splits(statements: DataFrame, unit: str) -> DataFrame:
    """Pairs of a causal and an intentional statement of one unit that share their middle (object of the one, subject of the other) and whose spans touch: unit, causal, intentional.
    An equi-join on unit and middle; the spans are a filter on it."""
    c = statements.where("dimension = 'causal'").select(unit, F.col("obj").alias("middle"), F.col("id").alias("causal"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    i = statements.where("dimension = 'intentional'").select(unit, F.col("subj").alias("middle"), F.col("id").alias("intentional"), F.col("start").alias("s"), F.col("end").alias("e"))
    return c.join(i, [unit, "middle"]).where("ce >= s AND e >= cs").select(unit, "causal", "intentional")


def nesting_position(edges: DataFrame, r: int = 2) -> DataFrame:
    """edges (parent, child) to (node, position): ancestors over ancestors and descendants within r hops."""
    up = G.within_hops(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), r).withColumnRenamed("signal", "up")
    down = G.within_hops(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), r).withColumnRenamed("signal", "down")
    a, d = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    return up.join(down, "node", "full").select("node", (a / (a + d)).alias("position"))


def conceptual_depth(nodes: DataFrame, links: DataFrame, edges: DataFrame, r: int = 2, link_scale: float = 5.0, anchor_scale: float = 2.0, link_weight: float = 0.5, nesting_weight: float = 0.5) -> DataFrame:
    """nodes (node), links (src, dst, kind: concept or anchor), edges (parent, child) to (node, depth): how deep a node lies, from those that link to it within r hops, from its anchors, which make it shallow, and
    from its place between what holds it and what it holds."""
    if min(link_scale, anchor_scale) <= 0 or min(link_weight, nesting_weight) < 0 or link_weight + nesting_weight <= 0:
        raise ValueError("scales are positive, weights 0 or more with a positive sum")
    signals = [G.link_signal(links, k, r).withColumnRenamed("signal", k) for k in ("concept", "anchor")]
    rows = nodes.select("node")
    for found in (*signals, nesting_position(edges, r)):
        rows = rows.join(found, "node", "left")
    rows = rows.na.fill(0)
    return rows.select("node", A.depth_blend(F.col("concept").cast("double"), F.col("anchor").cast("double"), F.col("position"), link_scale, anchor_scale, link_weight, nesting_weight).alias("depth"))


def conceptual_depth_from_profile(nodes: DataFrame, links: DataFrame, edges: DataFrame, profile: dict) -> DataFrame:
    p = resolve_profile(profile)
    return conceptual_depth(nodes, links, edges, p["r"], p["link_saturation"], p["anchor_saturation"], p["d_blend_weights"]["links"], p["d_blend_weights"]["nesting"])


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones (parent, child), each once; CycleError, and nothing is added, if one of them closes a cycle. The whole graph is peeled; where its order is kept beside it, topology.insert looks at the affected part alone."""
    together = stored(edges.select("parent", "child").union(new.select("parent", "child")).distinct(), "edges")
    levels(together)
    return together


def dual_split_violations(pairs: DataFrame) -> DataFrame:
    """pairs with the two statements under c_ and i_ (dimension, subj, obj, start, end) and `violations` (array of messages)."""
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    checks = [
        (~F.col("c_dimension").eqNullSafe(F.lit("causal")), "the first is not causal"), (~F.col("i_dimension").eqNullSafe(F.lit("intentional")), "the second is not intentional"), (differ("c_obj", "i_subj"), "no shared middle"),
        (F.coalesce((F.col("c_end") < F.col("i_start")) | (F.col("i_end") < F.col("c_start")), F.lit(False)), "the spans are apart"),
    ]
    return pairs.withColumn("violations", F.array_compact(F.array(*(F.when(wrong, said) for wrong, said in checks))))


def sorted_statements(statements: DataFrame) -> DataFrame:
    """In canonical order: dimension, subject, predicate, object, span; what is missing counts as empty or 0. A range sort."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return statements.orderBy(text("dimension"), text("subj"), text("predicate"), text("obj"), F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0)))


def statement_violations(s: dict) -> Column:
    """What is wrong with a statement, from its columns subj, obj, predicate, dimension, layer, weight (1 where missing), start and end, and of id, edge_confidence and negation those that are given."""
    from loomgraph.functions import text as T

    empty = lambda c: F.coalesce(c == "", F.lit(True))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    share = lambda c: c.between(0, 1) & ~F.isnan(c.cast("double"))
    of = T.predicate_dimension(s["predicate"])
    checks = [(empty(s["id"]), "id is empty"), (~empty(s["id"]) & no(s["id"].rlike("^[^#]+#[^#]+#[0-9a-f]{16}$")), "the id is not uri#date#hash")] if "id" in s else []
    checks += [
        (empty(s["subj"]), "subj is empty"), (empty(s["obj"]), "obj is empty"), (empty(s["predicate"]), "predicate is empty"), (~empty(s["predicate"]) & of.isNull(), "unknown predicate"), (empty(s["dimension"]), "no dimension"),
        (~empty(s["dimension"]) & ~A.is_dimension(s["dimension"]), "unknown dimension"), (of.isNotNull() & A.is_dimension(s["dimension"]) & (of != s["dimension"]), "not the predicate's dimension"),
        (no(s["layer"].isin(T.LAYERS)), "unknown layer"), (no(share(F.coalesce(s["weight"].cast("double"), F.lit(1.0)))), "weight out of range"),
    ]
    if "edge_confidence" in s:
        checks.append((no(share(s["edge_confidence"])), "no edge_confidence within 0 and 1"))
    checks += [(no(s["start"] >= 0), "no start of 0 or more"), (s["end"].isNull(), "no end"), (F.coalesce((s["start"] >= 0) & (s["end"] <= s["start"]), F.lit(False)), "the span is empty")]
    if "negation" in s:
        checks.append((no(s["negation"].isin("present", "uncertain", "absent")), "unknown negation"))
    return F.array_compact(F.array(*(F.when(wrong, said) for wrong, said in checks)))
