from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulse.operators import ingest as I
from pulse.operators.filters import apply_filters


def test_envelope_and_run_stats(spark):
    df = spark.createDataFrame([("https://a/1", "T", "body", "news", "esg_news"),
                                ("https://a/1", "T2", "body2", "rss", "esg_news"),
                                ("https://a/2", None, "b", "news", "x"),
                                ("", "e", "b", "news", "x")],
                               "url string, title string, content string, source_type string, search_topic string")
    env = I.envelope(I.union_sources(df))
    r = env.where("url = 'https://a/2'").first()
    assert r.language == "en" and r.content_length == "1" and r.author == ""
    ded = I.dedupe_first(env, order=[F.col("_phase"), F.col("title")])
    assert sorted(x.url for x in ded.collect()) == ["https://a/1", "https://a/2"]
    assert ded.where("url = 'https://a/1'").first().title == "T"
    stats = {r.source_type: r["count"] for r in I.run_stats(env, ded, "2024-01-01 00:00:00").collect()}
    assert stats == {"news": 3, "rss": 1, "total": 2}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", ""]), st.integers(0, 5)), max_size=12))
def test_dedupe_idempotent(spark, rows):
    df = spark.createDataFrame(rows or [("u1", 0)], "url string, pos int")
    once = I.dedupe_first(df, order=[F.col("pos"), F.col("url")])
    twice = I.dedupe_first(once, order=[F.col("pos"), F.col("url")])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_feed_cap_before_filter(spark):
    items = spark.createDataFrame(
        [("f1", i, "match me" if i == 21 else f"item {i}", "") for i in range(1, 26)] +
        [("f2", 1, "anything", "")],
        "feed_name string, item_no int, title string, summary string")
    feeds = I.feed_dimension(spark, [("f1", ["MATCH"]), ("f2", [])])
    out = I.feed_filter(I.cap_per_feed(items, 20), feeds)
    assert [(r.feed_name, r.item_no) for r in out.collect()] == [("f2", 1)]
    uncapped = I.feed_filter(items, feeds)
    assert sorted((r.feed_name, r.item_no) for r in uncapped.collect()) == [("f1", 21), ("f2", 1)]


def test_normalise_feed_and_gate(spark):
    items = spark.createDataFrame([
        ("T", "https://x/1", "<p>desc</p>", None, "A", "Mon, 06 May 2024 10:00:00 +0000", None, None),
        ("T", None, "d", None, None, None, None, None),
        ("T", "https://x/3", "", "", None, None, "2024-05-02", None)],
        "title string, link string, description string, summary string, author string, "
        "pubDate string, updated string, created string")
    n = {r.url: r for r in I.normalise_feed(items).collect()}
    assert set(n) == {"https://x/1"} and n["https://x/1"].content == "desc"
    assert n["https://x/1"].published_date == "2024-05-06T10:00:00"
    # an unparseable publication date does not hide a good later one
    late = items.where("link = 'https://x/1'").selectExpr("title", "link", "description", "summary", "author",
                                                          "'yesterday' as pubDate", "'2024-05-02T08:30:00' as updated", "created")
    assert I.normalise_feed(late).first().published_date == "2024-05-02T08:30:00"
    d = spark.createDataFrame([("https://x/1", "Mon, 06 May 2024 10:00:00 +0000")], "u string, d string")
    assert d.select(I.feed_date("d")).first()[0] is not None
    g = spark.createDataFrame([("u1", "", "a" * 79), ("u2", "", "a" * 80)], "url string, title string, content string")
    rows = I.gate_body(g).collect()
    assert [(r.url, r.title) for r in rows] == [("u2", "u2")]


def test_apply_filters_order_free(spark):
    df = spark.createDataFrame([("Social", "news", "The x"), ("Social", "ngo", "y"), ("Env", "news", "the z")],
                               "esg_category string, source_type string, title string")
    a = apply_filters(df, esg_category="Social", source_type=None, search="THE")
    b = apply_filters(df, search="the", esg_category="Social")
    assert a.collect() == b.collect() == [df.collect()[0]]
    assert apply_filters(df, search="%").count() == 0          # LIKE wildcards stay literal


def test_repeated_dimension_rows_do_not_fan_out(spark):
    pages = spark.createDataFrame([("u1",), ("u2",)], "url string")
    urls = spark.createDataFrame([("u1", "news", "b"), ("u1", "news", "a")], "url string, source_type string, topic string")
    got = sorted(tuple(r) for r in I.attach_url_meta(pages, urls).select("url", "source_type", "search_topic").collect())
    assert got == [("u1", "news", "a"), ("u2", "official", "direct_fetch")]
    feeds = I.feed_dimension(spark, [("f", [], "ngo", "water"), ("g", [])])
    items = spark.createDataFrame([("f",), ("g",), ("h",)], "feed_name string")
    got = sorted(tuple(r) for r in I.attach_feed_meta(items, feeds).select("feed_name", "source_type", "search_topic").collect())
    assert got == [("f", "ngo", "water"), ("g", "news", "feed"), ("h", "news", "feed")]
