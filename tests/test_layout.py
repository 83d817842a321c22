"""Clustered layout."""

import datetime as dt

from pyspark.sql import functions as F

from pulse.sources.layout import admitting, bucket, bucket_bounds, compact_clustered, file_ranges, interleaved, write_clustered

COLUMNS = ["kind", "topic", "day"]


def _table(spark, scratch, n=20_000):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000))
    df = spark.range(n).select(
        "id", F.concat(F.lit("s"), (h(1) % 6).cast("string")).alias("kind"),
        F.concat(F.lit("t"), (h(2) % 8).cast("string")).alias("topic"),
        F.when(h(4) < 10, None).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (h(3) % 120).cast("int"))).alias("day"))
    df.repartition(32).write.parquet(f"{scratch}/plain")
    return df


def test_files_that_admit_a_filter_are_few_on_every_column(spark, scratch):
    df = _table(spark, scratch)
    compact_clustered(spark, f"{scratch}/plain", f"{scratch}/clustered", COLUMNS, 32)
    spark.read.parquet(f"{scratch}/plain").repartitionByRange(32, "day").sortWithinPartitions("day").write.parquet(f"{scratch}/by_day")
    counts = {}
    day = dt.date(2024, 2, 10)
    for name in ("plain", "by_day", "clustered"):
        ranges = file_ranges(spark.read.parquet(f"{scratch}/{name}"), COLUMNS).cache()
        counts[name] = [ranges.count()] + [admitting(ranges, **w).count() for w in (
            {"kind": "s3"}, {"topic": "t5"}, {"day": (day, day + dt.timedelta(6))}, {"kind": "s3", "topic": "t5"})]
    before, sorted_, after = counts["plain"], counts["by_day"], counts["clustered"]
    assert before == [32] * 5                                   # every file holds every value
    assert all(a <= 0.65 * n for a, n in zip(after[1:], before[1:])) and after[4] <= 0.35 * before[4], counts
    assert sorted_[1] == sorted_[2] == sorted_[0]               # one sort column helps only itself
    a, b = spark.read.parquet(f"{scratch}/plain"), spark.read.parquet(f"{scratch}/clustered")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.schema == b.schema


def test_buckets_follow_the_bounds(spark):
    df = spark.createDataFrame([(v,) for v in [None, -3, 0, 1, 4, 5, 9, 100]], "v int")
    got = [r[0] for r in df.select(bucket("v", [0, 5, 9])).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 3, 3]
    key = spark.range(1).select(interleaved([F.lit(0b101), F.lit(0b011)], 3)).first()[0]
    assert key == 0b100111
    assert bucket_bounds(spark.createDataFrame([(None,), (None,)], "v int"), ["v"]) == {"v": []}


def test_empty_and_constant_columns(spark, scratch):
    df = spark.range(10).select("id", F.lit("x").alias("kind"), F.lit(None).cast("string").alias("topic"), F.current_date().alias("day"))
    write_clustered(df, f"{scratch}/constant", COLUMNS, 4)
    assert spark.read.parquet(f"{scratch}/constant").count() == 10
    write_clustered(df.limit(0), f"{scratch}/none", COLUMNS, 4)
    assert spark.read.parquet(f"{scratch}/none").count() == 0
