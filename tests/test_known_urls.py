"""Keep-first across runs."""

from pyspark.sql import functions as F

from pulse.operators.known_urls import KnownUrls, bloom_blocks, keep_new, probably_in


def _records(spark, rows):
    return spark.createDataFrame(rows, "url string, at int, body string")


def test_runs_keep_what_no_earlier_run_has_kept(spark, scratch):
    runs = {"2024-01-01": [("a", 2, "a2"), ("a", 1, "a1"), ("b", 1, "b1"), (None, 1, "x"), ("", 1, "y")],
            "2024-01-02": [("b", 0, "b0"), ("c", 5, "c5"), ("c", 4, "c4")], "2024-01-03": [("a", 0, "a0"), ("d", 1, "d1"), ("c", 0, "c0")]}
    want = {"2024-01-01": {"a1", "b1"}, "2024-01-02": {"c4"}, "2024-01-03": {"d1"}}
    for run, rows in runs.items():
        assert {r["body"] for r in keep_new(_records(spark, rows), [F.col("at")], scratch, run, blocks=8).collect()} == want[run]
    # a rerun, also of an old run, gives its old result and changes nothing
    for run in ("2024-01-02", "2024-01-03"):
        got = keep_new(_records(spark, runs[run]), [F.col("at")], scratch, run, blocks=8)
        assert {r["body"] for r in got.collect()} == want[run]
    known = KnownUrls(spark, scratch, 8)
    assert sorted(r["url"] for r in known.urls("9").collect()) == ["a", "b", "c", "d"]


def test_filter_misses_no_known_url_and_few_others(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("https://k/"), F.col("id").cast("string")).alias("url"))
    filters = bloom_blocks(urls, 8)
    assert filters.count() == 8 and filters.agg(F.max(F.length("bits"))).first()[0] == 4096
    assert probably_in(urls, filters, 8).where(~F.col("_probable")).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("https://n/"), F.col("id").cast("string")).alias("url"))
    assert probably_in(others, filters, 8).where("_probable").count() < 0.03 * 20_000
    assert probably_in(others, filters.limit(0), 8).where("_probable").count() == 0


def test_only_probable_repeats_reach_the_shuffle_of_the_anti_join(spark, scratch):
    keep_new(_records(spark, [(f"u{i}", i, "x") for i in range(300)]), [F.col("at")], scratch, "1", blocks=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = KnownUrls(spark, scratch, 8).new_records(_records(spark, [(f"u{i}", i, "x") for i in range(200, 500)]), [F.col("at")], "2")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the filter over the probed bits stands below the anti-join's exchange, right on the broadcast of the blocks
    below = plan[plan.index("LeftAnti"):]
    order = [below.index(x) for x in ("Exchange hashpartitioning(url", "Filter (", "BroadcastHashJoin")]
    assert order == sorted(order)
    assert "Exchange hashpartitioning" not in below[order[1]:order[2]]
    assert sorted(r["url"] for r in fresh.collect()) == sorted(f"u{i}" for i in range(300, 500))
