"""Metrics of micro-batches are stored."""

import json
import os

from pulse.streaming.incremental import run_bronze_stream, run_silver_stream
from pulse.streaming.metrics import MetricsTable, read_metrics, totals


def _land(path, name, n, source):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        for i in range(n):
            f.write(json.dumps({"url": f"https://s.example/{name}/{i}", "content": "word " * (40 if i else 3), "source_type": source}) + "\n")


def test_counts_are_read_back_from_the_table(spark, scratch):
    for name, n, source in (("a", 3, "news"), ("b", 4, "blog")):
        _land(f"{scratch}/landing", f"{name}.jsonl", n, source)
        run_bronze_stream(spark, f"{scratch}/landing", f"{scratch}/bronze", f"{scratch}/cb")
        with MetricsTable(spark, f"{scratch}/metrics") as listener:
            run_silver_stream(spark, f"{scratch}/bronze", f"{scratch}/silver", f"{scratch}/cs")
        assert not listener.errors
    # another session reads the same table
    rows = read_metrics(spark.newSession(), f"{scratch}/metrics")
    seen = {r["batch"]: r["counts"] for r in rows.where("name = 'silver_quality'").collect()}
    assert [seen[k]["valid_source_violations"] for k in sorted(seen)] == [0, 3]
    got = {r["metric"]: r["value"] for r in totals(rows.where("name <> ''")).collect()}
    assert got == {"rows": 5, "valid_content_violations": 0, "valid_url_violations": 0, "valid_source_violations": 3}
    assert rows.where("query = 'silver_articles'").count() == rows.count()
