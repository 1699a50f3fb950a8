"""Containment, closures, hop counts, typed path search and staleness over edge DataFrames."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.operators.bitmaps import neighbourhoods
from loomgraph.operators.order import running_sum
from loomgraph.operators.paths import typed_path_search  # noqa: F401
from loomgraph.profile import resolve_profile
from loomgraph.sources.tables import stored


class CycleError(ValueError):
    """An edge closes a cycle."""


def container_position(members: DataFrame, by: str) -> DataFrame:
    """members with a point (five doubles) to the fixed-point mean of each container: partial integer sums, so the order of rows cannot change it."""
    sums = members.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(A.to_fixed(A.guarded(F.col(d), "a member's point", float("-inf")))).alias(d) for d in A.DIMENSIONS))
    return sums.select(by, *(A.fixed_mean(F.col(d), F.col("n")).alias(d) for d in A.DIMENSIONS))


def trimmed_top_k(members: DataFrame, by: str, claim: str, weight: str, k: int = 5, n_min: int = 3, salt: str = "") -> DataFrame:
    """The members that count in each container: all when fewer than n_min, else the k heaviest; ties by salted hash. Only the best max(k, n_min - 1) of a container in each task are shuffled."""
    if not all(isinstance(x, int) and not isinstance(x, bool) and x > 0 for x in (k, n_min)):
        raise ValueError("k and n_min are positive whole numbers")
    order = Window.partitionBy(by).orderBy(F.desc(A.guarded(F.col(weight), "a weight", float("-inf"))), A.tiebreak_key(F.col(claim).cast("string"), salt))
    best = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, n_min - 1))
    if k >= n_min - 1:
        return best
    sizes = members.groupBy(by).agg(F.count("*").alias("_n"))
    return best.join(sizes, by).where((F.col("_n") < n_min) | (F.col("rank") <= k)).drop("_n")


def trimmed_match(members: DataFrame, by: str, claim: str, weight: str, k: int = 5, n_min: int = 3, salt: str = "") -> DataFrame:
    """By container: the fixed-point mean of the points of the members that count, and their claims by rank."""
    chosen = trimmed_top_k(members, by, claim, weight, k, n_min, salt)
    sums = chosen.groupBy(by).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("rank", claim))).alias("_claims"), *(F.sum(A.to_fixed(F.col(d))).alias(d) for d in A.DIMENSIONS))
    return sums.select(by, F.transform("_claims", lambda x: x[claim]).alias("claims"), *(A.fixed_mean(F.col(d), F.col("_n")).alias(d) for d in A.DIMENSIONS))


def trimmed_match_from_profile(members: DataFrame, by: str, claim: str, weight: str, profile: dict) -> DataFrame:
    p = resolve_profile(profile)
    return trimmed_match(members, by, claim, weight, p["k"], p["n_min"], p["tiebreak_salt"])


def quantiles(members: DataFrame, by: str, value: str) -> DataFrame:
    """members with quantile: the share of the other members of their container that are below them, 0 for a single one. Equal values are counted first, and one running sum over all containers in a row tells how many stand before each value, so neither a hot
    container nor a hot value lies in one task, however the values are spread. Members without a container or value have no quantile and are left out."""
    counts = members.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    placed = stored(running_sum(counts, [by, value], "_c", "_to", "long"), "values")
    spans = placed.groupBy(by).agg(F.min(F.col("_to") - F.col("_c")).alias("_from"), F.sum("_c").alias("_n"))
    share = F.when(F.col("_n") > 1, (F.col("_to") - F.col("_c") - F.col("_from")) / (F.col("_n") - 1)).otherwise(0.0)
    return members.join(placed.join(spans, by).select(by, value, share.alias("quantile")), [by, value])


def reverse_index(edges: DataFrame) -> DataFrame:
    """edges (parent, child) to every node with the sorted set of its parents."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    up = edges.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return nodes.join(up, "node", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (start) to (start, node, hops) for all nodes below, the start itself at 0 hops. One join a level; a level holds new pairs only, and is stored once."""
    front = stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct(), "level")
    seen, hops = front, 0
    while True:
        hops += 1
        step = front.join(edges, front.node == edges.parent).select("start", F.col("child").alias("node")).distinct()
        front = stored(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)), "level")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def within_hops(links: DataFrame, r: int) -> DataFrame:
    """links (src, dst) to (node, signal): distinct predecessors within r hops, the node itself excluded."""
    return neighbourhoods(links, r)


def link_signal(links: DataFrame, kind: str, r: int = 2) -> DataFrame:
    """links (src, dst, kind) to (node, signal): distinct predecessors within r hops over links of one kind (concept or anchor)."""
    return within_hops(links.where(F.col("kind") == kind).select("src", "dst"), r)


def product_graph_states(nodes: DataFrame) -> DataFrame:
    """How many states a typed search over nodes has: one for each node and dimension."""
    return nodes.agg((F.count("*") * len(A.DIMENSIONS)).alias("states"))


def would_cycle(edges: DataFrame, parent: str, child: str) -> bool:
    """Whether an edge from parent to child closes a cycle: the parent is the child, or below it."""
    if parent == child:
        return True
    start = edges.sparkSession.createDataFrame([(child,)], "start string")
    return not reachable(edges, start).where(F.col("node") == parent).isEmpty()


def stale_ancestors(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """edges (parent, child), changed (node) to (node, level): the changed nodes and every container above one, each once, with its longest distance from a changed node. Nodes of a level don't depend on each
    other, and all that a node depends on is at lower levels. A cycle above a changed node is a CycleError. The affected part is cut out once; it is then peeled from below, and every level is stored once."""
    from loomgraph.operators.topology import closure, levels

    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    affected = closure(up, changed.select("node"))
    inner = up.join(affected.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return affected.join(levels(inner), "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def propagation_order(parents: Mapping[str, Iterable[str]], changed: Iterable[str]) -> list[str]:
    """The one order in which changed nodes and their containers are derived again: each after all that it depends on, the least name first. For a graph that fits one process;
    stale_ancestors gives its levels at any size. Nodes on a cycle are not derived."""
    affected, stack = set(), list(changed)
    while stack:
        node = stack.pop()
        if node not in affected:
            affected.add(node)
            stack += parents.get(node, ())
    waits = dict.fromkeys(affected, 0)
    for child in affected:
        for p in set(parents.get(child, ())):
            waits[p] += 1
    ready = [n for n, w in waits.items() if w == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for p in set(parents.get(out[-1], ())):
            waits[p] -= 1
            if waits[p] == 0:
                heapq.heappush(ready, p)
    return out
