"""Readers and writers of the engine's own files, through Spark, so any store that Spark opens will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.extract import replay

_STEM = r"([0-9a-f]{64})\.json$"


def read_ruleset(spark: SparkSession, path: str) -> dict:
    """A ruleset, a small JSON document, as a mapping."""
    (row,) = spark.read.text(path, wholetext=True).limit(2).collect()
    return json.loads(row.value)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a line: doc (the text) and path."""
    return spark.read.text(path).select(F.col("value").alias("doc"), F.input_file_name().alias("path"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as units of text: unit (the path) and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("unit"), F.col("value").alias("text"))


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """key, decision (canonical JSON) of the files of a folder that are named by a key. A decision of another shape, or under another key than its own, is an error."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), _STEM, 1).alias("key"), F.col("value").alias("raw")).where("key <> ''")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            found = [replay.canonical(replay.read_decision(raw, key).as_dict()) for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["key", "decision"])

    return files.mapInArrow(read, "key string, decision string")


def candidate_sets(units: DataFrame, unit: str = "unit", text: str = "text", where: str | None = None) -> DataFrame:
    """unit, candidate_set (canonical JSON) and candidate_set_sha of each unit of text."""

    def propose(batches):
        import pyarrow as pa

        for b in batches:
            found = [replay.canonical(replay.propose(t or "", w).as_dict()) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array([replay.sha(x) for x in found], pa.string())], ["unit", "candidate_set", "candidate_set_sha"])

    rows = units.select(F.col(unit).cast("string").alias("unit"), F.col(text).alias("text"), (F.col(where) if where else F.lit(None).cast("string")).alias("where"))
    return rows.mapInArrow(propose, "unit string, candidate_set string, candidate_set_sha string")


def write_requests(sets: DataFrame, folder: str, view: str, model: str, prompt: str = replay.PROMPT) -> DataFrame:
    """Writes one line of JSON for each candidate set under `requests`, and unit to key under `mapping`; returns the mapping."""
    keyed = replay.keyed(sets, replay.sha(view), model, replay.sha(prompt))
    request = F.to_json(F.struct(F.lit(replay.SCHEMA).alias("schema_version"), F.col("key").alias("cache_key"), "candidate_set_sha", F.lit(model).alias("model_id"), F.lit(view).alias("coder_view_text"), F.lit(prompt).alias("prompt_template"), "candidate_set"))
    keyed.dropDuplicates(["key"]).select(request.alias("value")).write.mode("errorifexists").text(f"{folder.rstrip('/')}/requests")
    keyed.select("unit", "key").write.mode("errorifexists").json(f"{folder.rstrip('/')}/mapping")
    return keyed.sparkSession.read.schema("unit string, key string").json(f"{folder.rstrip('/')}/mapping")


def write_statements(statements: DataFrame, folder: str) -> None:
    """Statements as Parquet by dimension and predicate, so that readers of one predicate read its files alone."""
    statements.write.partitionBy("dimension", "predicate").mode("errorifexists").parquet(folder)
