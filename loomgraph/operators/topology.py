"""A topological order of the containment graph as a table (node, place) beside its edges, kept up by batches of edges.

An edge that goes with the order changes nothing. Edges against it span intervals of places, which are merged where they overlap; a batch searches inside these intervals only: what the children of its backward edges lead to, and what leads to their
parents. Every cycle that the batch would close lies in both sets (its core), so the core alone is peeled, level by level; the places that both sets have are dealt anew: first what only leads to a backward edge, in its old order, then the core by levels, then
what is only led to, in its old order. Nodes outside keep their places. All tables are read once to cut out the intervals; the rounds after that are over what lies inside, so their number and size follow from the region and not from the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import CycleError
from loomgraph.operators.order import numbered, running_max
from loomgraph.sources.tables import joined, stored


def levels(edges: DataFrame) -> DataFrame:
    """edges (parent, child) to (node, level): the longest way to a node from any that nothing leads to. A round for each level takes off the edges that leave it; of the nodes that these led to, those that no other edge leads to are the next level. What a round moves
    goes by the edges that it takes off, but for one reading of those that are left; CycleError if there are any and none can be taken off. Edges to nodes that hold nothing, mostly the bulk, stay out of the rounds: these nodes follow from the levels of their holders, in one join."""
    holders = stored(edges.select(F.col("parent").alias("node")).distinct(), "holders")
    held = holders.select(F.col("node").alias("child"), F.lit(True).alias("_holds"))
    deep = F.col("_holds").isNotNull() | F.col("parent").isNull()  # an edge from no node can't be taken off
    marked = stored(joined(edges.select("parent", "child"), held, "child", "left").select("parent", "child", deep.alias("deep")), "marked-edges")
    left = marked.where("deep").select("parent", "child")
    rest = left.count()
    front = stored(joined(holders, left.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)), "level")
    peeled, level = front, 0
    while rest:
        at = front.select(F.col("node").alias("parent"))
        met = stored(joined(left, at, "parent", "left_semi").select(F.col("child").alias("node")).distinct(), "met")
        left = stored(joined(left, at, "parent", "left_anti").select("parent", "child"), "unpeeled")
        found = left.count()  # from the files' footers
        if found == rest:
            raise CycleError("the edges form a cycle")
        rest, level = found, level + 1
        held = joined(left.select(F.col("child").alias("node")), met, "node", "left_semi").distinct() if rest else None
        front = met if held is None else joined(met, held, "node", "left_anti")
        front = front.withColumn("level", F.lit(level)) if held is None else stored(front.withColumn("level", F.lit(level)), "level")
        peeled = peeled.union(front)
    ends = joined(marked.where("NOT deep"), peeled.select(F.col("node").alias("parent"), "level"), "parent")
    return peeled.union(ends.groupBy(F.col("child").alias("node")).agg((F.max("level") + 1).alias("level")))


def placed(edges: DataFrame) -> DataFrame:
    """edges (parent, child) to (node, place): an order in which every container comes before what it holds, by level and name, from 0. Stored by ranges of place."""
    return stored(numbered(levels(edges), ["level", "node"], "place").select("node", "place"), "places")


def disordered(edges: DataFrame, places: DataFrame) -> DataFrame:
    """The edges that places don't hold for: none, unless the two tables don't belong together."""
    p, c = places.select(F.col("node").alias("parent"), F.col("place").alias("_p")), places.select(F.col("node").alias("child"), F.col("place").alias("_c"))
    return joined(joined(edges, p, "parent", "left"), c, "child", "left").where("_p IS NULL OR _c IS NULL OR _p >= _c").select("parent", "child")


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (node), and what edges (parent, child) lead to from them. Each round stores what is new; nothing is written twice."""
    front = stored(starts.select("node").distinct(), "front")
    seen = front
    while True:
        step = joined(front.withColumnRenamed("node", "parent"), edges, "parent").select(F.col("child").alias("node")).distinct()
        front = stored(joined(step, seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def insert(edges: DataFrame, places: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and places with a batch of new edges (parent, child), each once; CycleError if they would close a cycle, and then both tables are as they were, since none is changed in place. Callers store the places now and then, as the result reads
    the old ones."""
    new = stored(new.select("parent", "child").distinct(), "new-edges")
    if not new.where("parent = child").isEmpty():
        raise CycleError("a node can't hold itself")
    places, named = _with_new_nodes(places, new)
    p, c = (named.select(F.col("node").alias(end), F.col("place").alias(at), F.col("old").alias(f"_old_{end}")) for end, at in (("parent", "high"), ("child", "low")))
    new = stored(joined(joined(new, p, "parent", "left"), c, "child", "left"), "placed-batch")
    # What edges has already goes with the order, between nodes that had places.
    known = new.where("high < low AND _old_parent AND _old_child").select("parent", "child")
    if not known.isEmpty():
        new = joined(new, stored(joined(edges.select("parent", "child"), known, ["parent", "child"], "left_semi"), "known-edges"), ["parent", "child"], "left_anti")
    together = edges.select("parent", "child").union(new.select("parent", "child"))
    back = stored(new.where("high > low").select("parent", "child", "high", "low"), "backward-edges")
    if back.isEmpty():
        return together, places
    region = _region(places, back)
    at = lambda end: region.select(F.col("node").alias(end), F.col("span").alias(f"_{end}"))
    # By the child first: a container may hold very many, a member is in few, so few edges are left to meet the region by their parent.
    inner = stored(joined(joined(together, at("child"), "child"), at("parent"), "parent").where("_parent = _child").select("parent", "child"), "inner-edges")
    led = closure(inner, back.select(F.col("child").alias("node"))).withColumn("led", F.lit(True))
    leading = closure(inner.select(F.col("child").alias("parent"), F.col("parent").alias("child")), back.select(F.col("parent").alias("node"))).withColumn("leading", F.lit(True))
    moved = stored(joined(led.join(leading, "node", "full"), region, "node").select("node", "place", "span", F.col("led").isNotNull().alias("led"), F.col("leading").isNotNull().alias("leading")), "moved")
    core = moved.where("led AND leading").select("node")
    among = joined(joined(inner, core.withColumnRenamed("node", "parent"), "parent", "left_semi"), core.withColumnRenamed("node", "child"), "child", "left_semi")
    side = F.when(~F.col("led"), 0).when(F.col("leading"), 1).otherwise(2)
    ordered = joined(moved, levels(among), "node", "left").select("node", "place", "span", side.alias("side"), F.coalesce("level", F.lit(0)).alias("level"))
    # Both orders run through the spans alike, so the k-th node of the one gets the k-th place of the other.
    nodes = numbered(ordered, ["span", "side", "level", "place"], "k").select("node", "k")
    pool = numbered(moved.select("place"), ["place"], "k")
    dealt = stored(joined(nodes, pool, "k").select("node", F.col("place").alias("_new")), "dealt")
    return together, joined(places, dealt, "node", "left").select("node", F.coalesce("_new", "place").alias("place"))


def would_cycle(edges: DataFrame, places: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (parent, child) with `cycle`: whether the edge, put in alone, would close a cycle. Candidates are stored once beside the places of their ends; these answer for those that go with the order, and for new nodes. What the children of the others lead to is
    searched for all of them at once, no further than the candidate's own parent stands in the order, and only these candidates meet what was found."""
    p, c = places.select(F.col("node").alias("parent"), F.col("place").alias("_high")), places.select(F.col("node").alias("child"), F.col("place").alias("_low"))
    asked = stored(candidates.join(p, "parent", "left").join(c, "child", "left").select(*candidates.columns, "_high", "_low"), "candidates")
    against = F.coalesce(F.col("_high") > F.col("_low"), F.lit(False))
    # A search is known by its start and the place that it goes up to; starts that differ in that alone are one search, as far as the furthest.
    reach = asked.where(against).groupBy("child").agg(F.max("_high").alias("until"))
    front = stored(reach.select(F.col("child").alias("start"), F.col("child").alias("node"), "until"), "front")
    answered = asked.where(~against).select(*candidates.columns, F.coalesce(F.col("parent") == F.col("child"), F.lit(False)).alias("cycle"))
    if front.isEmpty():
        return answered
    to = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).join(places.select(F.col("node").alias("next"), "place"), "next")
    to = stored(to.select("node", "next", "place"), "placed-edges")  # a reader for each round
    seen = front
    while True:
        step = front.join(to, "node").where("place <= until").select("start", F.col("next").alias("node"), "until").distinct()
        front = stored(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    met = seen.select(F.col("start").alias("child"), F.col("node").alias("parent"), F.lit(True).alias("_yes"))
    searched = asked.where(against).join(met, ["child", "parent"], "left").select(*candidates.columns, F.col("_yes").isNotNull().alias("cycle"))
    return answered.union(searched)


def _with_new_nodes(places: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places with nodes that have none yet: before all others if nothing in the batch leads to them, else behind all others, by level among themselves, and by name. Beside it the places of the batch's own nodes, with `old`: whether they had one;
    all places are read once for these."""
    named = new.select(F.col("parent").alias("node"), F.lit(False).alias("held")).union(new.select("child", F.lit(True)))
    named = stored(joined(named.groupBy("node").agg(F.max("held").alias("held")), places, "node", "left").select("node", "held", "place"), "batch-nodes")
    fresh, known = named.where("place IS NULL").select("node", "held"), named.where("place IS NOT NULL").select("node", "place", F.lit(True).alias("old"))
    if fresh.isEmpty():
        return places, known
    first, last = places.agg(F.coalesce(F.min("place"), F.lit(0)), F.coalesce(F.max("place"), F.lit(-1))).first()
    heads = numbered(fresh.where("NOT held").select("node"), ["node"], "k").select("node", (first - 1 - F.col("k")).alias("place"))
    behind = fresh.where("held").select("node")
    among = joined(joined(new, behind.withColumnRenamed("node", "parent"), "parent", "left_semi"), behind.withColumnRenamed("node", "child"), "child", "left_semi")
    tails = numbered(joined(behind, levels(among), "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level")), ["level", "node"], "k").select("node", (last + 1 + F.col("k")).alias("place"))
    added = heads.union(tails)
    return places.union(added), known.union(added.withColumn("old", F.lit(False)))


def _region(places: DataFrame, back: DataFrame) -> DataFrame:
    """node, place and span of the nodes within the intervals (low, high) of backward edges, merged where they overlap; a span is named by its first place."""
    ends = running_max(back.select("low", "high"), ["low", "high"], "high", "reach", before=True)
    starts = running_max(ends.select("low", "high", F.when(F.col("reach").isNull() | (F.col("low") > F.col("reach")), F.col("low")).alias("start")), ["low", "high"], "start", "span")
    spans = stored(starts.groupBy("span").agg(F.max("high").alias("until")), "spans")
    low, high = spans.agg(F.min("span"), F.max("until")).first()
    inside = places.where(F.col("place").between(low, high))  # reaches the scan, which skips files by their places
    marked = inside.select("node", "place", F.lit(None).cast("long").alias("start")).union(spans.select(F.lit(None).cast("string"), "span", "span"))
    found = running_max(marked, ["place", F.col("start").asc_nulls_last()], "start", "span").where("node IS NOT NULL")
    return stored(joined(found, spans, "span").where("place <= until").select("node", "place", "span"), "region")
