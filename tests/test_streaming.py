import json
import os

from pulse.operators.clean import silver_articles, to_bronze
from pulse.sources.tables import read_landing
from pulse.streaming.incremental import observed_metrics, run_bronze_stream, run_silver_stream


def _write(path, name, recs, extra_lines=()):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in recs:
            f.write(json.dumps(r) + "\n")
        for line in extra_lines:
            f.write(line + "\n")


def _rec(i, src="news"):
    return {"article_id": f"id{i}", "url": f"https://s.example/{i}", "title": f"t{i}",
            "content": "<p>" + "word " * 40 + f"{i}</p>", "content_length": "205",
            "source_type": src, "search_topic": "esg_news", "published_date": "2024-03-01",
            "language": "", "_scraped_at": "2024-05-01T04:00:00+00:00"}


def test_incremental_bronze_silver(spark, scratch):
    land, bronze, silver = f"{scratch}/landing", f"{scratch}/bronze", f"{scratch}/silver"
    os.makedirs(land)
    q = run_bronze_stream(spark, land, bronze, f"{scratch}/ck_b", timeout_s=120)  # empty start
    _write(land, "a.jsonl", [_rec(1), _rec(2)], ["{not json", json.dumps({"url": None, "content": "x"})])
    run_bronze_stream(spark, land, bronze, f"{scratch}/ck_b", timeout_s=120)
    assert spark.read.parquet(bronze).count() == 2
    _write(land, "b.jsonl", [_rec(3, src="blog")])
    run_bronze_stream(spark, land, bronze, f"{scratch}/ck_b", timeout_s=120)
    run_bronze_stream(spark, land, bronze, f"{scratch}/ck_b", timeout_s=120)   # restart: nothing new
    b = spark.read.parquet(bronze)
    assert b.count() == 3
    assert b.where("_source_file IS NOT NULL").count() == 3
    sq = run_silver_stream(spark, bronze, silver, f"{scratch}/ck_s", timeout_s=120)
    s = spark.read.parquet(silver)
    batch = silver_articles(to_bronze(read_landing(spark, land)))
    cols = ["url", "clean_content", "scraped_date", "language"]
    assert sorted(s.select(cols).collect()) == sorted(batch.select(cols).collect())
    m = observed_metrics(sq)
    assert sum(x["valid_source_violations"] for x in m) == 1


def test_empty_landing_folder_streams_to_empty_tables(spark, scratch):
    import os
    from pulse.streaming.incremental import run_bronze_stream, run_silver_stream
    for d in ("landing", "bronze"):
        os.makedirs(os.path.join(scratch, d))
    run_bronze_stream(spark, f"{scratch}/landing", f"{scratch}/bronze", f"{scratch}/c1")
    run_silver_stream(spark, f"{scratch}/bronze", f"{scratch}/silver", f"{scratch}/c2")
