import os

from pulse.operators import ingest as I
from pulse.plans.ingest import run_ingest
from pulse.sources.tables import read_landing, read_run_log

BODY = "words that fill a body so that it passes the gate " * 4


def test_a_day_from_responses_pages_and_feeds_to_landing_and_run_log(spark, scratch):
    responses = spark.createDataFrame([
        ("esg_news", "news", "q", f"WEB RESULTS:\nURL: https://a/1\nTitle: One\nDescription: {BODY}\n"
                                  f"NEWS RESULTS:\nURL: https://a/2\nDescription: {BODY}\n"),
        ("esg_news", "news", "q", "Error: no answer"), ("esg_news", "news", "q", None)],
        "topic string, source_type string, query string, text string")
    contents = spark.createDataFrame([(f"URL: https://a/2\nTitle: again\nContent:\n{BODY}\nURL: https://c/1\nContent:\n{BODY}\n",)],
                                     "text string")
    items = spark.createDataFrame([
        ("f", 0, "Water", "https://f/1", f"<p>{BODY}</p>", "Mon, 06 May 2024 10:00:00 +0000"),
        ("f", 1, "Other", "https://f/2", BODY, None), ("g", 2, "Again", "https://a/1", BODY, None)],
        "feed_name string, item_no long, title string, link string, summary string, pubDate string").selectExpr(
        "*", "cast(null as string) description", "'A' author", "cast(null as string) updated", "cast(null as string) created")
    feeds = I.feed_dimension(spark, [("f", ["water"], "ngo", "water_rights"), ("g", [], "news", "general_news")])
    urls = spark.createDataFrame([("https://c/1", "official", "strategy")], "url string, source_type string, topic string")
    landing, log = os.path.join(scratch, "landing"), os.path.join(scratch, "log")
    run_ingest(responses, contents, items, feeds, urls, landing, log, "run-1", "2024-05-07T04:00:00")
    rows = {r.url: r for r in read_landing(spark, landing).collect()}
    assert set(rows) == {"https://a/1", "https://a/2", "https://c/1", "https://f/1"}
    assert (rows["https://a/1"].title, rows["https://c/1"].source_type, rows["https://c/1"].search_topic) == (
        "One", "official", "strategy")
    assert (rows["https://f/1"].source_type, rows["https://f/1"].search_topic, rows["https://f/1"].published_date) == (
        "ngo", "water_rights", "2024-05-06T10:00:00")
    assert {r._scrape_run_id for r in rows.values()} == {"run-1"}
    counts = {r.source_type: r["count"] for r in read_run_log(spark, log).collect()}
    assert counts == {"search": 4, "rss": 2, "total": 4}
    # a retried run replaces its batch and its log rows; a collector without records has its row too
    run_ingest(responses, contents, items, feeds, urls, landing, log, "run-1", "2024-05-07T04:00:00")
    run_ingest(responses, contents, items.limit(0), feeds, urls, landing, log, "run-2", "2024-05-08T04:00:00")
    assert read_landing(spark, landing).where("_scrape_run_id = 'run-1'").count() == 4
    rows = read_run_log(spark, log).collect()
    assert len(rows) == 6 and [r["count"] for r in rows if r["source_type"] == "rss"].count(0) == 1


def test_the_first_collected_record_of_a_url_is_kept_within_a_phase(spark, scratch):
    import json
    folder = os.path.join(scratch, "responses")
    os.makedirs(folder)
    block = lambda title: f"URL: https://a/1\nTitle: {title}\nDescription: {BODY}\n"
    for name, titles in (("2.jsonl", ["late"]), ("1.jsonl", ["early", "later"])):
        with open(os.path.join(folder, name), "w") as f:
            for t in titles:
                f.write(json.dumps({"topic": "esg_news", "source_type": "news", "query": t,
                                    "text": "WEB RESULTS:\n" + block(t) + "NEWS RESULTS:\n" + block(t + " second")}) + "\n")
    from pulse.plans.ingest import ingest_day
    from pulse.sources.tables import read_responses
    none = spark.createDataFrame([], "text string")
    items = spark.createDataFrame([], "feed_name string, item_no long, title string, link string, summary string, pubDate string, "
                                      "description string, author string, updated string, created string")
    feeds = I.feed_dimension(spark, [("f", [], "ngo", "water")])
    urls = spark.createDataFrame([], "url string, source_type string, topic string")
    records, log = ingest_day(read_responses(spark, folder), none, items, feeds, urls, "r", "2024-05-07T04:00:00")
    assert [r["title"] for r in records.collect()] == ["early"]
    assert {r["source_type"]: r["count"] for r in log.collect()} == {"search": 6, "rss": 0, "total": 1}
