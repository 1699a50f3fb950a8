"""Importance resampling towards a target distribution, on hashed runs of words.

Identical texts are collapsed by grouping the full text; a text's features (runs of 1 to 3 words) are hashed to buckets once for the counts, each counted as often as the text occurs, and once for its weight. Documents get the weight of their text
back by its 256-bit digest, and only then the noise of their own. The draw is by rank along one order of all documents (operators.order), so neither it nor any other step needs all rows in one task.

Defined cases: null and empty texts have no words, no features and weight 0; texts of any length are read whole; a null doc_id takes the noise of the empty string and comes first among equal scores; repeated rows have equal scores and take ranks one
by one; an empty target leaves all gains to smoothing; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import numbered
from loomgraph.sources.tables import spread

from .common import map_arrow, written
from .decontaminate import words

BUCKETS = 10_000


def buckets(found: list[bytes]) -> np.ndarray:
    """The buckets of all runs of 1 to 3 words, in no stated order: CRC-32 goes on from a run to the one that is a word longer."""
    after = [b" " + w for w in found[1:]]
    one = list(map(crc32, found))
    two = list(map(crc32, after, one))
    three = list(map(crc32, after[1:], two))
    return np.array(one + two + three, np.int64) % BUCKETS


def collapsed(docs: DataFrame) -> DataFrame:
    """text_id (SHA-256 of the text), text and copies: each different text once. Copies are added up before the shuffle."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_id"), "text", "copies")


def counts(texts: DataFrame) -> np.ndarray:
    """Features by bucket over all texts (text, copies): each task adds up its own, so a task sends BUCKETS rows at most."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x, copies in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                total += copies * np.bincount(buckets(words(x.as_py().encode())), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = map_arrow(texts.select("text", "copies"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    total = np.zeros(BUCKETS, np.int64)
    for r in found:
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a text's weight."""
    n, m = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (n + BUCKETS) / ((s + 1.0) * (m + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """text_id, n_words, n_features and weight of each text."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                found = words(x.as_py().encode())
                held = buckets(found)
                out.append((len(found), len(held), int(gain[held].sum())))
            cells = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cells[:, i]) for i in range(3))], ["text_id", "n_words", "n_features", "weight"])

    return map_arrow(texts.select("text_id", "text"), run, "text_id binary, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null if not drawn) of every row: of the documents with least_words or more, that share with the highest scores is drawn."""
    texts = written(collapsed(docs), "texts")
    gain = gains(counts(texts), counts(spread(target.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("copies")))))
    by_text = written(weights(texts, gain), "weights")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text_id"), F.monotonically_increasing_id().alias("row"))
    scored = written(rows.join(by_text, "text_id").select("doc_id", "row", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    ranked = numbered(scored.where(fit), [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("row")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    cells = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*cells, rank.alias("rank")).unionByName(scored.where(~fit).select(*cells, F.lit(None).cast("long").alias("rank")))
