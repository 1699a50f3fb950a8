"""Five stages over documents: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, BPE. Each reads what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, exact_dedup, near_duplicates, simhash, toxicity
from loomgraph.llm.common import left, release, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with all columns but doc_id and text under names that no operator uses, and the expressions that give them their own back."""
    names = {c: c if c in ("doc_id", "text") else f"own {i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(f"`{b}`").alias(a) for a, b in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for toxic. Null and empty texts get its base score; repeated rows get equal ones; a null doc_id has no label; an empty table gives an empty one; all columns stay."""
    rows, back = _aside(docs)
    model = toxicity.train(rows, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model).where("predicted = 0").select(*back)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty), the row with the largest doc_id stays; repeated rows of that doc_id stay for the next stage, and so do rows whose class has no doc_id at all."""
    rows, back = _aside(docs)
    return exact_dedup.exact_dedup(rows, keep="max").where("kept").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest doc_id, without doc_id only if no other has one; of several, that with the least hash.

    Two passes, the second on what the first leaves. First the op10 contract: SimHash components of 4-word shingles at 4 bits, whatever the size of a group; then the components of texts whose 5-word shingles have a Jaccard
    similarity of 0.8 or more, found in min-hash shards, or by prefixes of shingles where those are crowded, and checked exactly. Null and empty texts are one group; decisions are made by row, so null and repeated doc_ids are safe; an empty table gives an empty one."""
    own, back = _aside(docs)
    rows = written(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in own.columns if c != "doc_id"))
    prints = written(simhash.fingerprints(rows.withColumn("tie", tie), carry=("row", "tie")), "fingerprints")
    first = prints.join(simhash.clusters(prints), "fp").groupBy("label").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row"))
    rows = written(rows.join(first, "row", "left_semi"), "representatives")
    labels = near_duplicates.near_duplicates(rows)
    second = rows.select("row", "doc_id", tie.alias("tie")).join(labels, "row").groupBy("label").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(second, "row", "left_semi").select(*back)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item. Null and empty texts hold none; an empty benchmark drops nothing; repeated rows fare alike; all columns stay."""
    rows, back = _aside(docs)
    return decontaminate.clean(rows, table(spark, sf_dir, "benchmark")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left; a null text is empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("simhash near dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("bpe", encode)]
#: A trained classifier, XXH64 and BPE aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; what a stage and the one before it have written is deleted once its result stands."""
    docs, since = table(spark, sf_dir, "documents"), left()
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
        release(spark, since, 1)
    return docs
