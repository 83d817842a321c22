import datetime as dt

from pyspark.sql import functions as F

from pulse.operators.clean import expectation_report, silver_articles, to_bronze
from pulse.schemas import ARTICLE_LANDING


def _rec(url, content, source_type="news", published="", language="", scraped="2024-05-01T04:00:00Z"):
    return {"article_id": "id", "url": url, "url_hash": "h", "title": "t", "content": content,
            "content_length": None, "source_type": source_type, "search_topic": "governance",
            "author": "", "published_date": published, "language": language, "scraper": "s",
            "_scrape_run_id": "r", "_scraped_at": scraped, "_run_timestamp": scraped}


def test_silver_gates_and_normalisation(spark):
    ok = "x" * 150
    recs = [
        _rec("https://ok.example/1", ok, published="2024-03-05"),
        _rec("https://ok.example/2", "y" * 149),                  # too short
        _rec("https://ok.example/3", "<b>" + ok + "</b>", source_type="blog",
             published="May 1, 2024", language="fr"),             # illegal source: kept
        _rec("http://a.b", ok),                                    # url of 10 chars: dropped
        _rec("http://ab.c/", ok, published=None),                 # url of 12 chars: kept
        _rec(None, ok),                                            # no url: dropped in bronze
    ]
    landing = spark.createDataFrame(recs, ARTICLE_LANDING)
    silver = silver_articles(to_bronze(landing))
    rows = {r.url: r for r in silver.collect()}
    assert set(rows) == {"https://ok.example/1", "https://ok.example/3", "http://ab.c/"}
    assert rows["https://ok.example/1"].scraped_date == dt.date(2024, 3, 5)
    assert rows["https://ok.example/3"].scraped_date == dt.date(2024, 5, 1)   # non-ISO → scraped_at
    assert rows["https://ok.example/1"].language == "en"
    assert rows["https://ok.example/3"].language == "fr"
    assert rows["https://ok.example/1"].esg_hint == "Governance"
    rep = expectation_report(silver).first()
    assert rep.rows == 3 and rep.valid_source_violations == 1
