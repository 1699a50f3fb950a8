"""The registered queries of the corpus operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, interleave, perspectives, ranked_search, repeats, resample, secrets, simhash, token_orc, toxicity, warc
from .common import shared_dir, table


def op1_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    trained = F.size(F.filter("messages", lambda x: x["train"])).cast("long")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return found.select("conv_id", "perspective", "part", "n_rows", F.size("messages").cast("long").alias("n_messages"), trained.alias("n_trained"), F.length("text").cast("long").alias("n_chars"), digest.alias("text_sha256"), mask.alias("mask"))


def op3_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interleave.interleave(docs, shards=40).drop("source")


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op9_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(secrets.written_out("base").cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.written_out("spans").alias("spans"))


def op10_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op12_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_orc.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_orc.checksums(token_orc.read(spark, folder))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), percent=5)


QUERIES = {
    "op1_warc_writer": op1_warc_writer,
    "op2_perspective_rotation": op2_perspective_rotation,
    "op3_patricia_exact_dedup": op3_patricia_exact_dedup,
    "op4_weak_supervision_toxicity": op4_weak_supervision_toxicity,
    "op5_segment_tree_bpe": op5_segment_tree_bpe,
    "op6_stratified_interleave": op6_stratified_interleave,
    "op7_run_length_index": op7_run_length_index,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_credential_linking": op9_credential_linking,
    "op10_simhash_bk_tree": op10_simhash_bk_tree,
    "op11_tput_search": op11_tput_search,
    "op12_orc_tokens": op12_orc_tokens,
    "op13_importance_resampling": op13_importance_resampling,
}
