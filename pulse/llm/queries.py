"""One registered query per operator, at production parameters over its whole table, and its DuckDB SQL.

The queries are thin: each calls its operator and picks or digests the columns of the contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import (alignment, decontam, langid, licenses, line_dedup, lm, mixing, repair, simhash, toxicity, url_filter,
                       vector_search, warc)
from pulse.llm.common import crc_mod, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), teaches=toxicity.not_held_out)
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ","))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, stats = lm.score_documents(table(spark, sf_dir, "documents"), lm.not_held_out)
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         F.lit(stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_labels(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.exact_top_k(vectors, F.col("vec_id") % 20 == 0)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_conversations(rows, copies=F.col("copies"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, teaches=langid.not_held_out))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_url_filter": op2_url_filter,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_warc": op5_warc,
        "op6_line_dedup": op6_line_dedup,
        "op7_lm_scores": op7_lm_scores,
        "op8_license_scan": op8_license_scan,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_simhash_dedup": op10_simhash_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_language_id": op12_language_id,
        "op13_token_alignment": op13_token_alignment,
    }
