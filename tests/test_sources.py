import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pulse.operators import ingest as I
from pulse.operators.clean import to_bronze
from pulse.operators.filters import clamp
from pulse.sources.tables import (adhoc_select, append_run_log, read_feed_items, read_landing,
                                  read_run_log, run_log_view, write_landing)

RSS = """<?xml version="1.0"?>
<rss version="2.0"><channel><title>Feed</title>
<item><title>Water pledge</title><link>https://f.example/1</link>
<description>&lt;p&gt;The company pledges water savings&lt;/p&gt;</description>
<pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate></item>
<item><title>Other</title><link>https://f.example/2</link><description>Nothing relevant</description></item>
<item><title>No link</title><description>x</description></item>
</channel></rss>"""


def test_feed_xml_to_records(spark, scratch):
    d = os.path.join(scratch, "feeds")
    os.makedirs(d)
    with open(os.path.join(d, "water_news.xml"), "w") as f:
        f.write(RSS)
    items = read_feed_items(spark, d)
    assert items.count() == 3
    feeds = I.feed_dimension(spark, [("water_news", ["water"])])
    kept = I.normalise_feed(I.feed_filter(I.cap_per_feed(items, 20), feeds))
    rows = kept.collect()
    assert [r.url for r in rows] == ["https://f.example/1"]
    assert rows[0].content == "The company pledges water savings"
    assert kept.select(I.feed_date("published_date")).first()[0] is not None


def test_landing_roundtrip(spark, scratch):
    path = os.path.join(scratch, "landing")
    empty = spark.createDataFrame([], "url string, title string, content string, source_type string, search_topic string")
    write_landing(I.to_landing(I.envelope(empty)), path)
    assert read_landing(spark, path).count() == 0
    recs = spark.createDataFrame([("https://a/1", "t", "body", "news", "esg_news")],
                                 "url string, title string, content string, source_type string, search_topic string")
    landed = I.to_landing(I.stamp_run(I.envelope(recs), "run-1", "2024-05-01T04:00:00+00:00"))
    write_landing(landed, path, batch="r1")
    with open(os.path.join(path, "zz-bad.json"), "w") as f:
        f.write("{broken\n")
    b = to_bronze(read_landing(spark, path)).collect()
    assert len(b) == 1 and b[0].content_length == 4 and b[0]._scrape_run_id == "run-1"
    assert b[0].scraped_at == dt.datetime(2024, 5, 1, 4, 0)


def test_run_log_schema_evolution(spark, scratch):
    path = os.path.join(scratch, "runlog")
    append_run_log(spark.createDataFrame([("rss", 3, dt.datetime(2024, 5, 1)), ("total", 3, dt.datetime(2024, 5, 1))],
                                         "source_type string, count long, run_ts timestamp"), path)
    append_run_log(spark.createDataFrame([("search", 5, dt.datetime(2024, 5, 2), "v2")],
                                         "source_type string, count long, run_ts timestamp, version string"), path)
    raw = read_run_log(spark, path)
    assert "version" in raw.columns and raw.count() == 3
    assert sorted(r.source_type for r in run_log_view(raw).collect()) == ["rss", "search"]


def test_adhoc_select_guard(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    assert adhoc_select(spark, {"t": df}, "SELECT x FROM t").count() == 50
    assert adhoc_select(spark, {"t": df}, "WITH a AS (SELECT x FROM t) SELECT COUNT(*) FROM a;").first()[0] == 100
    with pytest.raises(ValueError):
        adhoc_select(spark, {"t": df}, "DROP VIEW t")


def test_adhoc_select_is_read_only(spark, scratch):
    df = spark.range(3).toDF("x")
    path = os.path.join(scratch, "out")
    df.write.parquet(os.path.join(scratch, "in"))
    for sql in (f"WITH a AS (SELECT x FROM t) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT x FROM a",
                f"SELECT * FROM parquet.`{scratch}/in`", "SELECT 1) UNION (DROP VIEW t"):
        with pytest.raises(Exception):
            adhoc_select(spark, {"t": df}, sql).collect()
    assert not os.path.exists(path)
    df.createOrReplaceTempView("secret")
    with pytest.raises(ValueError):
        adhoc_select(spark, {"t": df}, "SELECT * FROM secret")
    spark.catalog.dropTempView("secret")


def test_atom_entries_are_read(spark, scratch):
    with open(os.path.join(scratch, "a.xml"), "w") as f:
        f.write('<feed><entry><title>T</title><link href="https://x/1"/><summary>S</summary>'
                '<author><name>N</name></author><updated>2024-05-02T08:30:00</updated></entry></feed>')
    row = I.normalise_feed(read_feed_items(spark, scratch)).first()
    assert (row.url, row.title, row.content, row.author, row.published_date, row.feed_name) == (
        "https://x/1", "T", "S", "N", "2024-05-02T08:30:00", "a")


def test_clamp():
    assert clamp(50, 1, 200) == 50
    with pytest.raises(ValueError):
        clamp(0, 1, 200)


def test_adhoc_select_names_are_read_from_the_plan(spark, scratch):
    spark.range(3).createOrReplaceTempView("hidden_rows")
    spark.sql("CREATE DATABASE IF NOT EXISTS other_db")
    spark.sql(f"CREATE TABLE IF NOT EXISTS other_db.t USING parquet LOCATION '{scratch}/t' AS SELECT 1 AS x")
    df = spark.range(5).selectExpr("id AS x", "id AS hidden_rows", "'reflect(' AS note")
    try:
        # a column, an alias or a text may be called like a table or a function
        assert adhoc_select(spark, {"t": df}, "SELECT hidden_rows, 'reflect(1)' AS s FROM t").count() == 5
        assert adhoc_select(spark, {"t": df}, "WITH hidden AS (SELECT x FROM t) SELECT (SELECT MAX(x) FROM hidden) AS m").first()[0] == 4
        for sql in ("SELECT * FROM other_db.t", "SELECT * FROM hidden_rows", "SELECT x FROM t WHERE x IN (SELECT id FROM hidden_rows)",
                    "SELECT (SELECT MAX(id) FROM hidden_rows) FROM t", "WITH a AS (SELECT * FROM hidden_rows) SELECT * FROM a",
                    "SELECT * FROM range(10)", "SELECT * FROM IDENTIFIER('hidden_rows')",
                    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
                    "SELECT x FROM t WHERE java_method('java.lang.Math', 'abs', 1) = 1"):
            with pytest.raises(ValueError):
                adhoc_select(spark, {"t": df}, sql)
    finally:
        spark.sql("DROP TABLE IF EXISTS other_db.t")
        spark.sql("DROP DATABASE IF EXISTS other_db")
        spark.catalog.dropTempView("hidden_rows")


def test_landed_responses_are_parsed_in_collection_order(spark, scratch):
    import json
    import os

    from pulse.operators.search_text import explode_search_results
    from pulse.sources.tables import read_responses
    body = "words that fill a body so that it passes the gate " * 4
    os.makedirs(f"{scratch}/responses")
    for name, urls in (("b.jsonl", ["u/3", "u/1"]), ("a.jsonl", ["u/1", "u/2"])):
        with open(f"{scratch}/responses/{name}", "w") as f:
            for i, url in enumerate(urls):
                f.write(json.dumps({"topic": "esg_news", "source_type": "news", "query": f"{name}{i}",
                                    "text": f"WEB RESULTS:\nURL: https://{url}\nTitle: {name}\nDescription: {body}\n"}) + "\n")
    got = explode_search_results(read_responses(spark, f"{scratch}/responses")).orderBy("position", "block_no").collect()
    assert [(r["url"], r["search_query"]) for r in got] == [
        ("https://u/1", "a.jsonl0"), ("https://u/2", "a.jsonl1"), ("https://u/3", "b.jsonl0"), ("https://u/1", "b.jsonl1")]
    assert got[0]["search_topic"] == "esg_news" and got[0]["title"] == "a.jsonl"


def test_a_retried_batch_replaces_itself(spark, scratch):
    from pulse.sources.tables import append_run_log, read_landing, read_run_log, write_landing
    rows = spark.createDataFrame([("https://a/1", "x"), ("https://a/2", "y")], "url string, content string")
    log = spark.createDataFrame([("search", 2)], "source_type string, count long")
    append_run_log(spark.createDataFrame([("rss", 1)], "source_type string, count long"), f"{scratch}/log")
    for _ in range(2):
        write_landing(rows, f"{scratch}/landing", batch="run-1")
        append_run_log(log, f"{scratch}/log", run="run-1")
    write_landing(rows.limit(1), f"{scratch}/landing", batch="run-2")
    assert read_landing(spark, f"{scratch}/landing").count() == 3
    assert sorted((r["source_type"], r["count"]) for r in read_run_log(spark, f"{scratch}/log").collect()) == [("rss", 1), ("search", 2)]
