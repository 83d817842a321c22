"""The corpus pipeline: five of the operators, stage by stage, over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; each
result is written as Parquet and read again as the next stage's input.  The last stage adds the copy number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulse.llm import decontam, line_dedup, mixing, simhash, toxicity
from pulse.llm.common import saved, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``toxicity.THRESHOLD`` or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), teaches=toxicity.not_held_out)
    return toxicity.drop_toxic(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; every document stays, perhaps shorter or empty."""
    return line_dedup.dedup_lines(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut from the rest."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("simhash_dedup", keep_one_copy),
    ("decontamination", decontaminate),
    ("mix", mix),
]

ORACLE_SQL = None  # toxicity scores come from a trained model, which SQL can't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
