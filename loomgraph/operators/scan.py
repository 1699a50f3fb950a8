"""Running left folds of an operation on finitely many states, which need not be associative, over rows of a key in an order.

What an element does is a map from states to states, and maps do compose, whatever the operation: so rows are dealt by ranges of key and order, each range composes its maps on its own, and a second pass hands each range the state in which it begins. A key of
any number of rows is thus folded by many tasks at once. Within a range the composition is vectorised: maps are numbered, their products are a small table, and a batch is scanned by doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import stored

#: Different maps that an operation may generate at most; n states have n ** n.
MOST_MAPS = 4096


class Maps:
    """All maps that the elements generate, numbered: number 0 is the one that changes nothing, then come the elements'."""

    def __init__(self, states: Sequence[str], compose: Callable[[str, str], str]):
        self.states = list(states)
        place = {s: i for i, s in enumerate(self.states)}
        found = [tuple(range(len(states)))]
        number = {found[0]: 0}

        def of(m):
            if m not in number:
                if len(found) >= MOST_MAPS:
                    raise ValueError(f"the operation generates over {MOST_MAPS} maps")
                number[m] = len(found)
                found.append(m)
            return number[m]

        self.element = {e: of(tuple(place[compose(s, e)] for s in self.states)) for e in self.states}
        generators = [found[i] for i in set(self.element.values())]
        at = 0
        while at < len(found):
            for g in generators:
                of(tuple(g[i] for i in found[at]))
            at += 1
        self.maps = found
        #: then[a, b]: first a, then b.
        self.then = np.array([[number[tuple(b[i] for i in a)] for b in found] for a in found], np.int16)


def running_fold(rows: DataFrame, by: str, order: list[str], element: str, states: Sequence[str], compose: Callable[[str, str], str], start: str, name: str = "running", partitions: int | None = None) -> DataFrame:
    """rows with `name`: the fold of the elements of the rows of their key up to and with this one, beginning with `start`. `order` should tell the rows of a key apart. An element that is none of the states, or null, is an error; a null key is a key."""
    maps = Maps(states, compose)
    column = F.lit(None).cast("int")
    for e, i in maps.element.items():
        column = F.when(F.col(element) == e, i).otherwise(column)
    column = F.coalesce(column, F.raise_error(F.concat(F.lit("no state: "), F.coalesce(F.col(element).cast("string"), F.lit("NULL")))).cast("int"))
    dealt = rows.withColumn("_map", column)
    dealt = dealt.repartitionByRange(partitions, by, *order) if partitions else dealt.repartitionByRange(by, *order)
    then = maps.then

    def run(batches):
        segment, last, carry = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, m = b.column(by), b.column("_map").to_numpy().astype(np.int16)
            codes = keys.dictionary_encode("encode").indices.to_numpy()
            heads = np.concatenate(([True], codes[1:] != codes[:-1]))
            if keys[0].as_py() == last:
                m[0] = then[carry, m[0]]
            depth = np.arange(len(m)) - np.maximum.accumulate(np.where(heads, np.arange(len(m)), 0))  # rows of the key before, in this batch
            step = 1
            while step <= depth.max():
                far = np.flatnonzero(depth >= step)
                m[far] = then[m[far - step], m[far]]
                step *= 2
            last, carry = keys[len(m) - 1].as_py(), m[-1]
            at = b.schema.names.index("_map")
            yield b.set_column(at, "_map", pa.array(m.astype(np.int32))).append_column("_segment", pa.array(np.full(len(m), segment, np.int32)))

    schema = T.StructType([*dealt.schema.fields, T.StructField("_segment", T.IntegerType())])
    scanned = stored(dealt.sortWithinPartitions(by, *order).mapInArrow(run, schema), "scanned")

    # The state in which each range of a key begins; most keys lie in one.
    where = F.struct(*order)
    ends = scanned.groupBy(by, "_segment").agg(F.max_by("_map", where).alias("m"))
    acts = F.array(*(F.lit(i) for m in maps.maps for i in m))
    n, first = len(maps.states), maps.states.index(start)
    after = lambda m, state: F.element_at(acts, (m * n + state + 1).cast("int"))
    lists = ends.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_segment").alias("s"), "m"))).alias("l")).where(F.size("l") > 1)  # as long as there are ranges
    begins = F.aggregate(
        "l", F.struct(F.lit(first).alias("state"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct(after(x["m"], a["state"]).alias("state"), F.array_append(a["all"], a["state"]).alias("all")), lambda a: a["all"]
    )
    carried = lists.select(F.col(by).alias("_key"), F.explode(F.arrays_zip(F.transform("l", lambda x: x["s"]).alias("s"), begins.alias("b"))).alias("x")).select("_key", F.col("x.s").alias("_s"), F.col("x.b").alias("_begin"))
    found = scanned.join(carried, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_s")), "left")
    state = after(F.col("_map"), F.coalesce("_begin", F.lit(first)))
    return found.select(*rows.columns, F.element_at(F.array(*map(F.lit, maps.states)), (state + 1).cast("int")).alias(name))

