"""Kept and refused rows in one pass."""

from pyspark.sql import functions as F

from pulse.operators.clean import silver_articles
from pulse.operators.quarantine import judged_articles, kept, refused, write_judged
from pulse.plans import driver_tables as FP

SF = "/root/testdata/sf0.001"
OWN = ["_ingested_at", "_silver_at", "broken_rules", "warnings"]


def test_kept_rows_are_silver_and_refused_rows_name_their_rules(spark, scratch):
    bronze = FP.bronze(spark, SF)
    odd = (bronze.limit(4).withColumn("url", F.when(F.col("doc_id") % 2 == 0, "short").otherwise(F.col("url")))
           .withColumn("raw_content", F.when(F.col("doc_id") % 3 == 0, "<p>x</p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("y"), 20), F.repeat(F.lit("&nbsp;"), 200)))))
    bronze = bronze.unionByName(odd)
    write_judged(judged_articles(bronze), f"{scratch}/judged")
    silver = silver_articles(bronze)
    got = kept(spark, f"{scratch}/judged").drop(*OWN)
    want = silver.drop(*OWN)
    assert sorted(got.columns) == sorted(want.columns)
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    gone = refused(spark, f"{scratch}/judged")
    assert gone.count() + got.count() == bronze.count()
    rules = {tuple(r["broken_rules"]) for r in gone.select("broken_rules").distinct().collect()}
    assert ("valid_content",) in rules or ("valid_content", "valid_url") in rules
    assert gone.where(F.size("broken_rules") == 0).isEmpty()
    plan = kept(spark, f"{scratch}/judged")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(verdict" in plan       # refused files are not opened


def test_cleaning_runs_once_in_the_judging_plan(spark):
    """The regular expressions of the cleaning stand in one projection, not again in rules and filters."""
    plan = judged_articles(FP.bronze(spark, SF))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "<[^>]+>" in line]
    assert len(lines) == 1
