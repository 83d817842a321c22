import pytest
import os

from pyspark.sql import functions as F

from pulse.operators.enrich import (ModelResponder, RuleResponder, alignment_rule, enrich,
                                    lexicon_score, rule_sentiment)


def test_enrich_dedupes_and_caches(spark, scratch):
    log = os.path.join(scratch, "calls.log")
    cache = os.path.join(scratch, "cache")

    def call(prompts):
        with open(log, "a") as f:
            for p in prompts:
                f.write(p + "\n")
        return ['{"echo": "%s"}' % p for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, p string")
    out = enrich(df, F.col("p"), call, out="ans", cache_path=cache)
    got = {r.id: r.ans for r in out.collect()}
    assert got[1] == got[2] == '{"echo": "a"}' and got[4] is None
    assert sorted(open(log).read().split()) == ["a", "b"]           # one call per distinct prompt
    df2 = spark.createDataFrame([(5, "a"), (6, "c")], "id int, p string")
    ModelResponder(call, cache_path=cache).answer(df2, F.col("p"), "ans").collect()
    assert sorted(open(log).read().split()) == ["a", "b", "c"]      # warm cache: only the new prompt


def test_rule_standins(spark):
    df = spark.createDataFrame([("Great progress, excellent results",), ("scandal and fraud",), ("",)], "t string")
    s = [r[0] for r in df.select(lexicon_score("t")).collect()]
    assert s[0] > 0.5 and s[1] < -0.5 and s[2] == 0.0
    out = RuleResponder(rule_sentiment("t")).answer(df, F.lit(None), "j")
    assert out.first().j.startswith('{"sentiment":"positive"')
    a = spark.createDataFrame([(0.5, 10.0), (None, None), (-1.0, 100.0)], "period_avg_sentiment double, avg_pct_critical double")
    assert [r[0] for r in a.select(alignment_rule()).collect()] == [7, 5, 0]


def test_lexicon_table_operator_equals_fold(spark):
    from pulse.operators.enrich import lexicon_score, lexicon_scores
    rows = [(1, "Great progress, but a scandal and a recall."), (2, None), (3, "nothing to see"),
            (4, "GOOD good Good bad-bad"), (5, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    fold = {r.k: r.s for r in df.select("k", lexicon_score("t").alias("s")).collect()}
    table = {r.k: r.score for r in lexicon_scores(df, "k", "t").collect()}
    assert table == fold
    assert table[2] is None and table[3] == 0.0 and table[4] > 0


def test_keyword_table_operator_equals_fold(spark):
    from pulse.operators.enrich import CATEGORY_KEYWORDS, keyword_class, keyword_classes
    rows = [(1, "Carbon and water; the board."), (2, None), (3, "no keywords here"),
            (4, "board audit workers"), (5, "workers board"), (6, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    fold = {r.k: r.c for r in df.select(
        "k", keyword_class("t", CATEGORY_KEYWORDS, "Not-ESG").alias("c")).collect()}
    table = {r.k: r.c for r in keyword_classes(df, "k", "t", CATEGORY_KEYWORDS, "Not-ESG", "c").collect()}
    assert table == fold
    assert table[1] == "Environmental" and table[2] is None and table[3] == "Not-ESG"
    assert table[5] == "Social"          # tie → earlier class


def test_token_table_operators_plan(spark):
    """Broadcast fixed dimension, partial aggregate before the one shuffle, no Python."""
    from pulse.operators.enrich import CATEGORY_KEYWORDS, keyword_classes, lexicon_scores
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for q in (lexicon_scores(df, "doc_id", "text"),
              keyword_classes(df, "doc_id", "text", CATEGORY_KEYWORDS, "Not-ESG")):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "partial_" in plan
        assert "PythonUDF" not in plan and "ArrowEval" not in plan


def test_an_unreadable_cache_is_not_an_empty_cache(spark, scratch):
    import os
    from pulse.operators.enrich import _read_cache
    assert _read_cache(spark, None) is None and _read_cache(spark, os.path.join(scratch, "none")) is None
    with pytest.raises(Exception):
        _read_cache(spark, "nostore://x/y")
