import random

from pyspark.sql import functions as F

from pulse.operators.quantiles import grouped_median

EDGE_VALUES = [0.0, -0.0, 1.0, -1.0, 0.5, 1.5, 1.25, 1e308, -1e308, 5e-324, -5e-324,
               2.2250738585072014e-308, 1.0000000000000002, 0.9999999999999999,
               float("inf"), float("-inf"), 1024.0, 1023.9999999999999, -7.25]


def test_grouped_median_equals_percentile(spark):
    rnd = random.Random(7)
    data = []
    for g, n in enumerate([1, 2, 3, 10, 1001, 4000]):
        for _ in range(n):
            c = rnd.random()
            x = (rnd.gauss(0, 1e6) if c < 0.4
                 else rnd.choice([0.0, 1.5, -2.0, 3.25]) if c < 0.7     # heavy ties
                 else rnd.uniform(-1e-300, 1e-300) if c < 0.8
                 else None)
            data.append((None if g == 5 else f"k{g}", g % 2, x))       # NULL key group
    data += [("all-null", 0, None), ("edges", 1, None)]
    data += [("edges", 1, v) for v in EDGE_VALUES]
    df = spark.createDataFrame(data, "a string, b int, v double")
    want = {(r.a, r.b): r.p for r in
            df.groupBy("a", "b").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert want.pop(("all-null", 0)) is None
    got = {(r.a, r.b): r.m for r in grouped_median(df, ["a", "b"], "v", "m").collect()}
    assert got == want


def test_events_median_plan_holds_no_group_values(spark):
    """The registered median never keeps a group's values in one buffer."""
    import __spark_entry__ as E
    df = E.queries()["e06_median_by_group"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert "percentile_approx" in plan and "percentile(" not in plan      # a fixed-size sketch


def test_large_group_median_equals_percentile(spark):
    """More rows than a sketch holds, with ties next to the middle."""
    df = spark.range(120_001).selectExpr("id % 2 as k", "case when id % 3 = 0 then 7.5 else rand(3) * 15 end as v")
    df = spark.createDataFrame(df.collect(), df.schema)
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert {r.k: r.m for r in grouped_median(df, ["k"], "v", "m").collect()} == want


def test_weekly_radix_median_equals_percentile(spark):
    from pulse.plans import datasets as L
    from pulse.plans import driver_tables as FP
    ins = FP.insights(spark, "/root/testdata/sf0.001")
    cols = L.WEEK_KEYS + ["median_sentiment_score"]
    a = sorted(map(tuple, L.weekly_sentiment(ins).select(*cols).collect()), key=repr)
    b = sorted(map(tuple, L.weekly_sentiment(ins, radix_median=True).select(*cols).collect()), key=repr)
    assert a == b and len(a) > 0


def test_median_on_driver_events(spark):
    """Every group of the real events table."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet") \
        .select("event_type", F.to_date("ts").alias("day"), "value")
    keys = ["event_type", "day"]
    want = {(r[0], r[1]): r[2] for r in e.groupBy(*keys).agg(F.percentile("value", 0.5)).collect()
            if r[2] is not None}
    got = {(r[0], r[1]): r[2] for r in
           grouped_median(e, keys, "value").collect()}
    assert got == want and len(want) > 10
