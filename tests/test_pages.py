"""G1: pages through the rank index."""

import re

from pyspark.sql import functions as F

from pulse.operators.pages import RankIndex, in_order, write_ranked

def _order():
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def _index(spark, scratch, n=3000):
    # a hot score, nulls and ties
    df = spark.range(n).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 5)
                               .otherwise(F.col("id") % 50).alias("score"), (F.col("id") % 4).alias("kind"))
    write_ranked(df, f"{scratch}/ranks", _order(), 12)
    return df, RankIndex(spark, f"{scratch}/ranks")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_page_equals_limit_and_offset(spark, scratch):
    df, index = _index(spark, scratch)
    rows = df.orderBy(*_order()).collect()
    for offset in (0, 1, 49, 1000, 2990, 2999, 3000, 10_000):
        assert in_order(index.page(offset, 50)).collect() == rows[offset:offset + 50]
    assert index.total().first()[0] == 3000
    pages = [r for k in range(0, 3000, 400) for r in in_order(index.page(k, 400)).collect()]
    assert pages == rows


def test_filtered_pages_count_matching_rows_only(spark, scratch):
    df, index = _index(spark, scratch)
    for cond in (F.col("kind") == 2, F.col("score").isNull(), F.col("score") == 5, F.col("kind") == 9):
        rows = df.where(cond).orderBy(*_order()).collect()
        for offset in (0, 7, len(rows) // 2, max(0, len(rows) - 3), len(rows) + 5):
            assert in_order(index.page(offset, 20, lambda d: d.where(cond))).collect() == rows[offset:offset + 20]


def test_deep_page_reads_covered_ranges_without_a_deep_limit(spark, scratch):
    _, index = _index(spark, scratch)
    page = index.page(2500, 50)
    plan = _plan(in_order(page))
    assert "TakeOrderedAndProject" not in plan and "Limit" not in plan and "Exchange" not in plan
    ranges = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "_range" in ranges
    read = page.select("_range").distinct().count()
    assert 1 <= read <= 2
    assert len(page.inputFiles()) == 12 and index.rows.where(F.col("_range") == 3).rdd.getNumPartitions() < 12


def test_empty_table_and_order_expressions(spark, scratch):
    df = spark.createDataFrame([], "id long, score long, kind long")
    write_ranked(df, f"{scratch}/none", _order(), 4)
    index = RankIndex(spark, f"{scratch}/none")
    assert index.page(0, 10).collect() == [] and index.total().first()[0] == 0
