import uuid

from pyspark.sql import functions as F

from pulse.functions import json as J
from pulse.functions.ids import sha_key, uuid5_url
from pulse.functions.labels import alignment_band, sentiment_bucket, severity_rank
from pulse.functions.text import clean_text, preview

URLS = ["https://a.b/c", "https://example.org/é?q=1&x=ü", "http://x.y/" + "z" * 300]


def test_uuid5_matches_python(spark):
    df = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "url string")
    got = {r.url: r.id for r in df.select("url", uuid5_url("url").alias("id")).collect()}
    for u in URLS:
        assert got[u] == str(uuid.uuid5(uuid.NAMESPACE_URL, u))
    assert got[None] is None


def test_clean_and_preview_edges(spark):
    raw = "<p>Hello&nbsp;&amp;  <b>world</b>\n\n\t&quot;x&quot;</p><script>var a=1;</script>"
    r = spark.createDataFrame([(raw,)], "t string").select(
        clean_text("t").alias("c"), preview("t", 12).alias("p")).first()
    assert r.c == "Hello world x var a=1;"
    assert r.p == "Hello&nbsp;&"  # entities kept in the preview, cut at 12 chars


def test_sha_key_null_propagates(spark):
    r = spark.createDataFrame([("a", None)], "a string, b string").select(
        sha_key("a", "b").alias("k"), sha_key("a", F.lit("x")).alias("k2")).first()
    assert r.k is None and len(r.k2) == 64


def test_labels(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(sentiment_bucket("x")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]
    got = [r[0] for r in df.select(sentiment_bucket("x", 0.1, unknown="unknown")).collect()]
    assert got == ["neutral", "neutral", "neutral", "unknown"]
    sev = spark.createDataFrame([("critical",), ("low",), ("x",), (None,)], "s string")
    assert [r[0] for r in sev.select(severity_rank("s")).collect()] == [1, 4, 5, 5]
    al = spark.createDataFrame([(7,), (4,), (3,), (None,)], "a int")
    assert [r[0] for r in al.select(alignment_band("a")).collect()] == [
        "aligned", "partial", "divergent", None]


def test_json_answer_edges(spark):
    rows = [('{"sentiment": "positive", "score": 0.5, "stance": "critical"}',),
            ('```json\n{"sentiment": "negative", "score": -0.5}\n```',),
            ('{"sentiment": "positive", "sco',),
            ('{"sentiment": null, "stance": "null"}',)]
    df = spark.createDataFrame(rows, "j string")
    out = df.select(J.field("j", "sentiment").alias("s"), J.field("j", "stance").alias("st"),
                    J.parse_sentiment("j")["score"].alias("p"),
                    J.parse_sentiment("j", fenced=True)["score"].alias("pf")).collect()
    assert [r.s for r in out] == ["positive", None, None, None]
    assert out[3].st == "null"                      # the text "null" is kept
    assert out[1].p is None and out[1].pf == -0.5   # fences only stripped on request
    assert out[2].p is None


def test_claims_array_edges(spark):
    rows = [("[]",), ('{"claim_text": "single"}',), ("garbage",), (None,),
            ('[{"claim_text": "a"}, null, {"claim_text": "b"}]',)]
    df = spark.createDataFrame(rows, "j string")
    ex = df.select(F.explode(J.parse_claims("j")).alias("c")).where(F.col("c").isNotNull())
    assert sorted(r.c.claim_text for r in ex.collect()) == ["a", "b", "single"]


def test_parse_ok_flag(spark):
    rows = [('{"a": 1}',), ('  {"a": 1}',), ('```json\n{"a": 1}\n```',), ('{"a": ',), ("[1]",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(J.parse_ok("j")).collect()]
    assert got == [True, True, False, False, False, False]


def test_median_exact_and_bounded(spark):
    from pulse.functions.agg import median
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 10]], "x double")
    assert df.agg(median("x")).first()[0] == 3.0                  # interpolated, exact
    assert df.agg(median("x", 10000)).first()[0] in (2.0, 4.0)    # a data value from the sketch


def test_average_survives_one_absurd_value(spark):
    from pulse.functions.agg import avg_round
    df = spark.createDataFrame([(0.5,), (1e30,), (0.25,)], "v double")
    assert df.agg(avg_round("v", 4)).first()[0] == 0.375
