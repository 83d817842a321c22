"""Aggregates refreshed by runs."""

import os

import pytest
from pyspark.sql import functions as F

from pulse.plans import dashboard as M
from pulse.plans import datasets as L
from pulse.plans import driver_tables as FP
from pulse.plans.rollups import DailyRollup, refresh_daily, refresh_weekly

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def insights(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ins") / "insights")
    FP.insights(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_weekly_runs_give_a_full_rebuild_and_rewrite_touched_weeks_only(spark, scratch, insights):
    cut = insights.selectExpr("percentile_approx(scraped_date, 0.7)").first()[0]
    late = F.col("scraped_date") > F.lit(cut)
    refresh_weekly(insights.where(~late), scratch, "run-1")
    before = _files(f"{scratch}/weekly_sentiment")
    touched = refresh_weekly(insights.where(late), scratch, "run-2")
    after = _files(f"{scratch}/weekly_sentiment")
    weeks = {f"week_start={w}" for w in touched}
    kept = {f for f in before if f.split("/")[0] not in weeks}
    assert kept and all(after[f] == before[f] for f in kept)
    assert {f.split("/")[0] for f in after if before.get(f) != after[f]} == weeks
    got = spark.read.parquet(f"{scratch}/weekly_sentiment")
    assert _rows(got) == _rows(L.weekly_sentiment(insights))
    # a retried run changes nothing; a row of an untouched week reaches its week
    refresh_weekly(insights.where(late), scratch, "run-2")
    assert _rows(spark.read.parquet(f"{scratch}/weekly_sentiment")) == _rows(L.weekly_sentiment(insights))
    more = insights.where(~late).limit(3)
    refresh_weekly(more, scratch, "run-3")
    assert _rows(spark.read.parquet(f"{scratch}/weekly_sentiment")) == _rows(L.weekly_sentiment(insights.unionByName(more)))


def test_daily_runs_and_kpis(spark, scratch, insights):
    nulls = insights.limit(4).withColumn("scraped_date", F.lit(None).cast("date"))
    everything = insights.unionByName(nulls)
    half = F.pmod(F.xxhash64("article_id", "scraped_date"), F.lit(2)) == 0
    for run, rows in (("run-1", everything.where(half)), ("run-2", everything.where(~half)), ("run-1", everything.where(half))):
        refresh_daily(rows, scratch, run)
    rollup = DailyRollup(spark, scratch)
    assert _rows(rollup.stats()) == _rows(L.daily_stats(everything))
    for bounds in ({}, {"date_from": "2024-02-01"}, {"date_from": "2024-01-10", "date_to": "2024-03-01"}, {"date_from": "2030-01-01"}):
        assert _rows(rollup.kpis(**bounds)) == _rows(M.kpis(everything, **bounds)), bounds
    plan = rollup.kpis(date_from="2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "daily_facts" in plan and "daily_sets" in plan and "sentiment_label" not in plan
    assert "PartitionFilters: [isnotnull(day" in plan
