"""Dimension algebra, coordinates and fixed-point numbers as Catalyst expressions. Columns go in and come out; nothing runs in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.profile import resolve_profile

#: The dimensions in canonical order.
DIMENSIONS = ["structural", "causal", "intentional", "temporal", "relational"]


def is_dimension(c: Column) -> Column:
    return F.coalesce(c.isin(DIMENSIONS), F.lit(False))


def compose(a: Column, b: Column) -> Column:
    """Of two consecutive edges: relational is neutral on the right, causal holds over structural, else the later one. NULL for an unknown dimension."""
    out = F.when(b == "relational", a).when((a == "causal") & (b == "structural"), a).otherwise(b)
    return F.when(is_dimension(a) & is_dimension(b), out)


def left_fold(order: Column, dim: Column) -> Column:
    """Aggregate: the strict left fold of compose over a group, in order, from two maxima that combine before the shuffle. Without its relational members a path's fold is its last
    one, unless that is structural: then causal if that precedes the trailing structural run, else structural."""
    last = F.max_by(F.when(dim != "relational", dim), F.when(dim != "relational", order))
    inner = ~dim.isin("relational", "structural")
    before = F.max_by(F.when(inner, dim), F.when(inner, order))
    return F.when(last.isNull(), "relational").when(last != "structural", last).when(before == "causal", "causal").otherwise("structural")


def dimension(c: Column) -> Column:
    """c, or an error where it names no dimension."""
    return F.when(is_dimension(c), c).otherwise(F.raise_error(F.concat(F.lit("unknown dimension "), F.coalesce(c, F.lit("null")))))


def fold_path(path: Column) -> Column:
    """An array of (dimension, weight), in order, to one: the fold of the dimensions, and the product of the weights (1 where missing) multiplied in that order. Empty paths, unknown dimensions and weights outside 0 and 1 are errors."""
    start = F.struct(F.lit("relational").alias("dimension"), F.lit(1.0).alias("weight"))
    step = lambda s, x: F.struct(compose(s["dimension"], dimension(x["dimension"])).alias("dimension"), (s["weight"] * guarded(F.coalesce(x["weight"], F.lit(1.0)), "a weight", 0.0, 1.0)).alias("weight"))
    return F.when(F.size(path) > 0, F.aggregate(path, start, step)).otherwise(F.raise_error(F.lit("an empty path has no fold")))


def ingest_window(as_of: Column, now: Column, seconds: float) -> Column:
    """Of a view that is stale for an ingest: its age, and whether it may still be served (up to and at the end of the window). An error without as_of."""
    age = now - F.when(as_of.isNotNull(), as_of).otherwise(F.raise_error(F.lit("a view has no as_of")))
    return F.struct(age.alias("age"), (age <= seconds).alias("servable"))


def product(weight: Column) -> Column:
    """Aggregate: the product of weights at six decimals, from partial products, so no group is held in one place."""
    return round6(F.product(F.coalesce(weight, F.lit(1.0))))


def zero_contributions() -> list[Column]:
    return [F.lit(0).cast("long").alias(d) for d in DIMENSIONS]


def with_embeds(count: Column) -> list[Column]:
    """Contributions with what a node contains added to the structural one; an error for a negative count."""
    held = F.coalesce(count, F.lit(0)).cast("long")
    held = F.when(held < 0, F.raise_error(F.lit("a count of embeds is negative"))).otherwise(held)
    return [(F.coalesce(F.col(d), F.lit(0)) + (held if d == "structural" else F.lit(0))).alias(d) for d in DIMENSIONS]


def guarded(c: Column, what: str, low: float = 0.0, high: float | None = None) -> Column:
    """c, or an error where it is not a finite number from low to high."""
    wrong = c.isNull() | F.isnan(c.cast("double")) | (c < low) | (F.abs(c.cast("double")) == float("inf"))
    wrong = wrong if high is None else wrong | (c > high)
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{what} is out of range: "), F.coalesce(c.cast("string"), F.lit("null"))))).otherwise(c)


def contributions(dim: Column) -> list[Column]:
    """Aggregates: rows of each dimension."""
    return [F.count(F.when(dim == d, 1)).alias(d) for d in DIMENSIONS]


def round6(c: Column) -> Column:
    """Half to even at six decimals (exact for dyadic ties, the only ones that shares and points have)."""
    return F.bround(c, 6)


def shares() -> list[Column]:
    """An error for a negative contribution."""
    total = reduce(lambda a, b: a + b, (guarded(F.col(d), "a contribution") for d in DIMENSIONS))
    return [F.when(total == 0, 0.0).otherwise(round6(F.col(d) / total)).alias(d) for d in DIMENSIONS]


def dominant() -> Column:
    """The first of the dimensions with the largest contribution; relational if none is positive."""
    top = F.greatest(*DIMENSIONS)
    return F.when(top <= 0, "relational").otherwise(F.coalesce(*(F.when(F.col(d) == top, d) for d in DIMENSIONS)))


def basis() -> Column:
    return F.when(F.greatest(*DIMENSIONS) > 0, "planes").otherwise("default")


def point(saturation: float | dict[str, float] = 5.0) -> list[Column]:
    """saturation: one for all dimensions, or by dimension (5 where none is named)."""
    sat = {d: float(saturation.get(d, 5.0) if isinstance(saturation, dict) else saturation) for d in DIMENSIONS}
    if min(sat.values()) <= 0 or isinstance(saturation, dict) and set(saturation) - set(DIMENSIONS):
        raise ValueError(f"saturations are positive and by known dimensions: {saturation!r}")
    return [round6(F.least(guarded(F.col(d), "a contribution") / F.lit(sat[d]), F.lit(1.0))).alias(d) for d in DIMENSIONS]


def point_from_profile(profile: dict) -> list[Column]:
    return point(resolve_profile(profile)["point_saturation"])


def cosine(p: list[Column], q: list[Column]) -> Column:
    """Sums in canonical order; zero when either norm is zero."""
    dot = reduce(lambda a, b: a + b, (x * y for x, y in zip(p, q, strict=True)))
    norm = lambda v: F.sqrt(reduce(lambda a, b: a + b, (x * x for x in v)))
    both = norm(p) * norm(q)
    return F.when(both == 0, 0.0).otherwise(round6(dot / both))


def to_fixed(c: Column) -> Column:
    """Millionths, half away from zero, from the binary product."""
    x = c.cast("double") * F.lit(1e6)
    return F.when(x >= 0, (x + 0.5).cast("long")).otherwise(-((-x + 0.5).cast("long")))


def from_fixed(c: Column) -> Column:
    return c / F.lit(1e6)


def fixed_mean(total: Column, n: Column) -> Column:
    """Half away from zero, in integers; NULL where n is not positive."""
    half = F.floor(n / 2)
    t, h, m = (x.cast("long") for x in (total, half, n))
    up = ((F.abs(t) + h) - (F.abs(t) + h) % m) / m
    return F.when(n > 0, F.when(t >= 0, up.cast("long")).otherwise(-up.cast("long")))


def tiebreak_key(identifier: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), identifier).cast("binary"), 256)


def combine_scores(term: Column, structural: Column, term_weight: float = 0.7, structural_weight: float = 0.3) -> Column:
    """An error for a score outside 0 and 1."""
    if not (min(term_weight, structural_weight) >= 0 and 0 < term_weight + structural_weight < float("inf")):
        raise ValueError("weights are 0 or more and have a positive sum")
    term, structural = guarded(term, "a score", 0.0, 1.0), guarded(structural, "a score", 0.0, 1.0)
    return round6((term * term_weight + structural * structural_weight) / (term_weight + structural_weight))


def combine_scores_from_profile(term: Column, structural: Column, profile: dict) -> Column:
    w = resolve_profile(profile)["match_blend_weights"]
    return combine_scores(term, structural, w["term"], w["structural"])


def relational_effective(relational: Column, others: Column, scale: float = 1.0) -> Column:
    return round6(relational * scale / (scale + others))


def relation_key(c: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s_-]+", "")


def depth_blend(links: Column, anchors: Column, nesting: Column, link_scale: float = 5.0, anchor_scale: float = 2.0, link_weight: float = 0.5, nesting_weight: float = 0.5) -> Column:
    deep, surface = links / (links + F.lit(link_scale)), anchors / (anchors + F.lit(anchor_scale))
    blend = (F.lit(link_weight) * deep * (1 - surface) + F.lit(nesting_weight) * nesting) / (link_weight + nesting_weight)
    return round6(F.least(F.greatest(blend, F.lit(0.0)), F.lit(1.0)))


def depth_blend_from_profile(links: Column, anchors: Column, nesting: Column, profile: dict) -> Column:
    p = resolve_profile(profile)
    return depth_blend(links, anchors, nesting, p["link_saturation"], p["anchor_saturation"], p["d_blend_weights"]["links"], p["d_blend_weights"]["nesting"])


def debounce(times: Column, window: float, threshold: int) -> Column:
    """Flushes of sorted times: a window is anchored at its first event, closes at `threshold` events, and is flushed partly by a gap or the end."""
    state = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("out"))

    def step(s, t):
        joins = (s["n"] > 0) & (t - s["at"] <= window)
        n = F.when(joins, s["n"] + 1).otherwise(1)
        full = n >= threshold
        out = s["out"] + F.when(~joins & (s["n"] > 0), 1).otherwise(0) + F.when(full, 1).otherwise(0)
        return F.struct(F.when(joins, s["at"]).otherwise(t).alias("at"), F.when(full, 0).otherwise(n).alias("n"), out.alias("out"))

    return F.aggregate(F.array_sort(times), state, step, lambda s: s["out"] + F.when(s["n"] > 0, 1).otherwise(0))
