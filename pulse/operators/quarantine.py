"""Kept and refused rows in one pass, refused ones with the rules they break.

The drop rules of the silver step remove rows for good; here one pass names every broken rule and writes both kinds, so a refused
row can be looked at, mended and landed again.  ``verdict`` is the partition column: readers of ``kept`` never
open a refused file.  Warn rules are named on kept rows too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators.clean import drop_rules, silver_articles, warn_rules
from pulse.schemas import MIN_CLEAN_CHARS
from pulse.sources.tables import materialize

KEPT, REFUSED = "kept", "refused"


def raw_rules() -> dict[str, Column]:
    """The gate before cleaning, as a rule."""
    return {"raw_length": F.length(F.trim("raw_content")) >= MIN_CLEAN_CHARS}


def broken(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order (null counts as broken)."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]),
                    lambda x: x.isNotNull())


def judged_articles(bronze: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Every bronze article as a silver row with ``broken_rules`` (drop rules and the raw gate), ``warnings`` and ``verdict``."""
    gate = bronze.withColumn("_raw_broken", broken(raw_rules()))
    cleaned = silver_articles(gate, keep=[*keep, "_raw_broken"], expectations=False, gate=False)
    out = cleaned.select("*", F.concat("_raw_broken", broken(drop_rules())).alias("broken_rules"),
                         broken(warn_rules()).alias("warnings")).drop("_raw_broken")
    return out.withColumn("verdict", F.when(F.size("broken_rules") == 0, KEPT).otherwise(REFUSED))


def write_judged(judged: DataFrame, path: str, partition_by: Iterable[str] = (), sort_by: Iterable[str] = ()) -> None:
    """Kept and refused rows to ``path``/verdict=…, in one job; cut and sorted further like ``tables.materialize``."""
    materialize(judged, path, partition_by=["verdict", *partition_by], sort_by=sort_by)


def kept_path(path: str) -> str:
    """The folder of the kept rows: a table of its own."""
    return f"{path.rstrip('/')}/verdict={KEPT}"


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows that break no rule: the silver table."""
    return spark.read.parquet(path).where(F.col("verdict") == KEPT).drop("verdict", "broken_rules")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """The refused rows with the rules they break."""
    return spark.read.parquet(path).where(F.col("verdict") == REFUSED).drop("verdict")
