import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from pulse.llm import warc

DDL = "page_id long, url string, html string"
PAGES = [(i, f"http://x.org/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [
    (100, None, None), (101, "http://é.org/a b\r\nX: y", "ü€\r\n\r\n"), (102, "u", "z" * 300_000), (None, "u", "<p>1</p>"),
    (None, "u", "only null"), (7, "again", "<p>0</p><p>0</p>"), (102, "u", "z" * 300_000)]


def brute(pages):
    best = {}
    for page_id, _, html in pages:
        best[html or ""] = max([p for p in (best.get(html or ""), page_id) if p is not None], default=None)
    out = []
    for page_id, _, html in pages:
        data, last = (html or "").encode(), best[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, "response" if page_id == last else "revisit", None if page_id == last else last, digest, len(data)))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark, tmp_path):
    df = spark.createDataFrame(PAGES, DDL).repartition(3).withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    folder, index = warc.write_archives(df, str(tmp_path / "w"))
    read = warc.read_records(index, folder).collect()
    assert sorted((tuple(r)[:5] for r in read), key=str) == brute(PAGES)
    texts = {(p, (h or "").encode()) for p, _, h in PAGES}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in read if r["record_type"] == "response")
    assert {r["url"] for r in index.collect()} == {u for _, u, _ in PAGES}
    for r in index.collect():       # every record alone is a gzip member of a WARC file
        with open(os.path.join(folder, r["archive"]), "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\n")


def test_selected_records_only(spark, tmp_path):
    folder, index = warc.write_archives(spark.createDataFrame(PAGES, DDL), str(tmp_path / "w"))
    some = index.where(F.col("page_id").isin("3", "50", "102"))
    assert sorted(r["page_id"] for r in warc.read_records(some, folder).collect()) == [3, 50, 102, 102]
    assert warc.read_records(index.limit(0), folder).collect() == []


def test_small_equal_payloads_are_all_responses_if_asked(spark, tmp_path):
    folder, index = warc.write_archives(spark.createDataFrame(PAGES, DDL), str(tmp_path / "w"), min_bytes=100)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read_records(index, folder).collect()}
    assert {k for _, k in kinds} == {"response"}
    assert warc.write_archives(spark.createDataFrame([], DDL), str(tmp_path / "e"))[1].collect() == []


def test_ranges_are_coalesced_and_damage_is_found():
    rows = [(0, 10), (10, 5), (20, 5), (200, 5), (205, 50)]
    assert list(warc.ranges(rows, gap=8, most=54)) == [(0, 3, 25), (3, 4, 5), (4, 5, 50)]
    member, _ = warc.record("1", "u", b"abc", None, False)
    damaged = gzip.compress(gzip.decompress(member).replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parse(damaged)
