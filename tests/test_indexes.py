"""C18 title search and B8 keyword matching through inverted indexes."""

import time

import pytest
from pyspark.sql import functions as F

from pulse.functions.text import contains_ci, grams
from pulse.operators import ingest as I
from pulse.operators.keyword_index import feed_filter_indexed, keyword_index, open_feeds
from pulse.operators.title_index import TitleIndex, needle_grams, write_title_index


def test_grams(spark):
    df = spark.createDataFrame([("abcab", ), ("ab",), (None,), ("a\nbc",), ("éßü😀x",)], "t string")
    assert [sorted(r[0]) for r in df.select(grams("t", 3)).collect()][:4] == [["abc", "bca", "cab"], [], [], ["\nbc", "a\nb"]]
    assert {"éßü", "ßü😀", "ü😀x"} <= set(df.select(grams("t", 3)).collect()[4][0])


def _titles(spark, scratch):
    words = ["Water", "reCALL", "100% safe", "the", "émission", "a_b", "Plant", "x"]
    df = spark.range(800).select("id", F.when(F.col("id") % 41 == 0, None).otherwise(F.concat_ws(" ", *[
        F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
        for k in range(4)])).alias("title"))
    write_title_index(df, f"{scratch}/titles", [F.col("id")], 8)
    return df, TitleIndex(spark, f"{scratch}/titles")


def test_search_equals_contains(spark, scratch):
    df, index = _titles(spark, scratch)
    for needle in ("water", "RECALL", "% s", "the x", "Émission", "a_b", "ab", "x", "nowhere", "safe safe safe", ""):
        want = df.where(contains_ci(F.col("title"), needle)) if needle else df
        assert sorted(r["id"] for r in index.search(needle).collect()) == sorted(r["id"] for r in want.collect()), needle
    assert needle_grams("AbAb") == ["aba", "bab"]


def test_search_prunes_ranges_by_the_candidates(spark, scratch):
    df = spark.range(4000).select("id", F.when(F.col("id") == 1234, "needle in hay").otherwise("only hay").alias("title"))
    write_title_index(df, f"{scratch}/t", [F.col("id")], 16)
    found = TitleIndex(spark, f"{scratch}/t").search("needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()         # folders are chosen by the candidates' ranges before titles are read
    assert "PushedFilters: [In(gram" in plan        # postings by the needle's grams
    assert [r["id"] for r in found.collect()] == [1234]


def _items(spark, rows):
    return spark.createDataFrame(rows, "feed_name string, item_no long, title string, summary string")


@pytest.mark.parametrize("keywords", [["Water", "the plant", "é", "a.b", "zz"], [], [""], ["ab", None, "abcdefgh"]])
def test_index_equals_the_loop(spark, keywords):
    rows = [("f", i, t, s) for i, (t, s) in enumerate([
        ("WATER works", None), (None, "in the Plant"), ("É", ""), (None, None), ("axb", "a.b"), ("z", "z"), ("abcdefgh", "x"), ("", "ab")])]
    items = _items(spark, rows + [("g", 1, "any", "thing"), ("none", 1, "water", "")])
    feeds = spark.createDataFrame([("f", keywords, None, None), ("g", None, None, None)],
                                  "feed_name string, filter_keywords array<string>, source_type string, topic string")
    got = feed_filter_indexed(items, keyword_index(feeds), open_feeds(feeds))
    want = I.feed_filter(items, feeds)
    assert sorted((r["feed_name"], r["item_no"]) for r in got.collect()) == sorted((r["feed_name"], r["item_no"]) for r in want.collect())


def test_fifty_thousand_keywords(spark):
    word = lambda k: F.substring(F.md5(F.concat(F.lit(k), F.col("id").cast("string"))), 1, 9)
    items = spark.range(3000).select(F.lit("f").alias("feed_name"), F.col("id").alias("item_no"), word("t").alias("title"),
                                     F.concat_ws(" ", *[word(f"s{k}") for k in range(12)], F.when(
                                         F.col("id") % 10 == 0, word("k"))).alias("summary"))

    def run(n):
        feeds = spark.range(n).select(word("k").alias("w")).groupBy().agg(F.collect_set("w").alias("filter_keywords")).select(
            F.lit("f").alias("feed_name"), "filter_keywords")
        index = keyword_index(feeds).cache()
        index.count()
        start = time.time()
        found = sorted(r["item_no"] for r in feed_filter_indexed(items, index, open_feeds(feeds)).collect())
        return time.time() - start, found
    run(50)
    few, found_few = run(500)
    many, found = run(50_000)
    assert found == [i for i in range(3000) if i % 10 == 0] and found_few == [i for i in range(500) if i % 10 == 0]
    assert many < 10 * few + 5      # a hundred times the keywords
