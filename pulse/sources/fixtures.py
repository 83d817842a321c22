"""Deterministic article landing frame derived from the driver tables.

``documents ⟕ labels`` becomes one landing record per document (the shape the
scrapers write), plus four model-answer columns (sentiment, ESG, claims,
event) so the enrichment steps have answers without a network.  Every value
is arithmetic on ``doc_id``, CASE and concatenation, so the SQL oracle can
build the same frame independently.

Scale: one pass over ``documents``; the label join is an equi-join on
``doc_id`` that Spark broadcasts only while ``labels`` is under the session's
broadcast threshold (AQE re-checks at runtime) and sort-merges beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.ids import url_hash, uuid5_url
from pulse.sources.tables import spread_scan

# Fixed answer vocabularies used by the fixture (ordered by the modulus index).
FIXTURE_SOURCE_TYPES = ["official", "news", "social", "ngo", "benchmark", "rss"]
FIXTURE_TOPICS = ["environmental", "worker_sentiment", "governance", "esg_news",
                  "product_recall", "crisis_media", "direct_fetch", "market_impact"]
FIXTURE_CATEGORIES = ["Environmental", "Social", "Governance", "Cross-ESG", "Not-ESG"]
FIXTURE_CLAIM_CATEGORIES = ["Environmental", "Social", "Governance"]
FIXTURE_CLAIM_TYPES = ["commitment", "achievement", "target", "certification"]
FIXTURE_EVENT_TYPES = ["recall", "regulatory", "financial", "reputational", "positive", "other"]
FIXTURE_REGIONS = ["APAC", "Europe", "France", "Global"]
FIXTURE_SEVERITIES = ["low", "medium", "high", "critical"]   # index 4 → JSON null
AS_OF = "2024-04-30"

# Extra columns the fixture carries alongside the landing fields.
FIXTURE_KEEP = ["doc_id", "sentiment_answer", "esg_answer", "claims_answer", "event_answer"]


def _d() -> Column:
    return F.col("doc_id")


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] as a CASE chain (native, codegen friendly)."""
    e = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        e = F.when(idx == i, F.lit(values[i])).otherwise(e)
    return e


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _sentiment_answer(stance: Column) -> Column:
    D = _d()
    s100 = (D * 37) % 201 - 100
    label = F.when(s100 >= 5, "positive").when(s100 <= -5, "negative").otherwise("neutral")
    topics = F.when(D % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"t'), _s(D % 7), F.lit('", "t'), _s(D % 3 + 7), F.lit('"')))
    js = F.concat(F.lit('{"sentiment": "'), label, F.lit('", "score": '), _s(s100),
                  F.lit('e-2, "confidence": '), _s((D * 13) % 101),
                  F.lit('e-2, "key_topics": ['), topics, F.lit('], "stance": "'), stance,
                  F.lit('"}'))
    js = F.when(D % 19 == 0, F.substring(js, 1, 30)).otherwise(js)
    return F.when(D % 17 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)


def _esg_answer(source_type: Column) -> Column:
    D = _d()
    cat = _pick(FIXTURE_CATEGORIES, D % 5)
    theme = F.when(D % 23 == 0, F.lit("null")).otherwise(
        _q(F.concat(cat, F.lit("/"), _s(F.floor(D / 6) % 3))))
    cred = F.when(D % 29 == 0, F.lit("7.5")).otherwise(_s((D * 7) % 11))
    official = F.when(source_type == "official", F.lit("true")).otherwise(F.lit("false"))
    summary = F.when(D % 31 == 0, F.lit("null")).otherwise(
        _q(F.concat(F.lit("Impact summary "), _s(D), F.lit("."))))
    return F.concat(F.lit('{"esg_category": "'), cat, F.lit('", "esg_sub_theme": '), theme,
                    F.lit(', "confidence": '), _s((D * 3) % 100),
                    F.lit('e-2, "key_claims": ["k'), _s(D % 3),
                    F.lit('"], "is_official_csr": '), official,
                    F.lit(', "impact_summary": '), summary,
                    F.lit(', "credibility_score": '), cred, F.lit("}"))


def _claim(i: int) -> Column:
    D = _d()
    k = D + i
    ccat = _pick(FIXTURE_CLAIM_CATEGORIES, k % 3)
    cat_json = F.lit("null") if i == 2 else _q(ccat)
    theme = F.when(k % 5 == 0, F.lit("null")).otherwise(
        _q(F.concat(ccat, F.lit("/"), _s(k % 3))))
    metric = _q(F.concat(_s(D % 50), F.lit("%"))) if i == 1 else F.lit("null")
    timeframe = F.when(k % 2 == 0, F.lit('"2030"')).otherwise(F.lit("null"))
    return F.concat(F.lit('{"claim_text": "claim '), _s(D), F.lit(f"-{i}"),
                    F.lit('", "esg_category": '), cat_json,
                    F.lit(', "sub_theme": '), theme,
                    F.lit(', "metric": '), metric,
                    F.lit(', "timeframe": '), timeframe,
                    F.lit(', "claim_type": "'), _pick(FIXTURE_CLAIM_TYPES, k % 4), F.lit('"}'))


def _claims_answer() -> Column:
    D = _d()
    n = F.floor(D / 7) % 4
    c1, c2, c3 = _claim(1), _claim(2), _claim(3)
    sep = F.lit(", ")
    return (F.when(n == 0, F.lit("[]"))
            .when(n == 1, F.concat(F.lit("["), c1, F.lit("]")))
            .when(n == 2, F.concat(F.lit("["), c1, sep, c2, F.lit("]")))
            .otherwise(F.concat(F.lit("["), c1, sep, c2, sep, c3, F.lit("]"))))


def _event_answer() -> Column:
    D = _d()
    sev = F.when(D % 5 == 4, F.lit("null")).otherwise(_q(_pick(FIXTURE_SEVERITIES, D % 5)))
    region = F.when(D % 8 == 7, F.lit("null")).otherwise(_q(_pick(FIXTURE_REGIONS, D % 4)))
    product = F.when(D % 7 == 0, F.lit('"null"')).otherwise(
        _q(F.concat(F.lit("Product "), _s(D % 9))))
    fin = F.when(D % 3 == 0, F.lit("null")).otherwise(
        _q(F.concat(_s(D % 50), F.lit("M EUR"))))
    return F.concat(F.lit('{"event_type": "'), _pick(FIXTURE_EVENT_TYPES, D % 6),
                    F.lit('", "severity": '), sev,
                    F.lit(', "affected_region": '), region,
                    F.lit(', "affected_product": '), product,
                    F.lit(', "financial_impact_estimate": '), fin,
                    F.lit(', "recommended_response": "Respond to event '), _s(D), F.lit('"}'))


def article_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing-shaped article records (all strings) + fixture answer columns."""
    D = _d()
    docs = spread_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id", "left")

    k = F.when(D % 10 == 9, D - 1).otherwise(D)
    url = F.concat(F.lit("https://news.example.org/a/"), _s(k))
    source_type = F.when(D % 97 == 0, F.lit("blog")).otherwise(_pick(FIXTURE_SOURCE_TYPES, D % 6))
    pd_kind = F.floor(D / 5) % 5
    published = (F.when(pd_kind == 0, F.lit(""))
                 .when(pd_kind == 1, F.lit("May 1, 2024"))
                 .when(pd_kind == 2, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("2024-03-"), F.lpad(_s(D % 28 + 1), 2, "0"))))
    scraped_day = F.date_add(F.lit("2024-01-01").cast("date"), (D % 120).cast("int"))
    scraped_at = F.concat(F.date_format(scraped_day, "yyyy-MM-dd"), F.lit("T04:00:00Z"))
    stance = (F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 1, "supportive")
              .when(F.col("quality") == 0, "mixed").otherwise("neutral"))

    base = d.select(
        D.alias("doc_id"),
        url.alias("url"),
        F.when(D % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring("text", 1, 80)).alias("title"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>&nbsp;")).alias("content"),
        _s(F.col("n_chars")).alias("content_length"),
        source_type.alias("source_type"),
        _pick(FIXTURE_TOPICS, D % 8).alias("search_topic"),
        F.col("source").alias("author"),
        published.alias("published_date"),
        F.when(D % 13 == 0, F.lit("")).otherwise(F.col("lang")).alias("language"),
        F.lit("fixture").alias("scraper"),
        F.concat(F.lit("run-"), F.date_format(scraped_day, "yyyyMMdd")).alias("_scrape_run_id"),
        scraped_at.alias("_scraped_at"),
        scraped_at.alias("_run_timestamp"),
        stance.alias("_stance"),
    )
    return base.select(
        uuid5_url("url").alias("article_id"), "url", url_hash("url").alias("url_hash"),
        "title", "content", "content_length", "source_type", "search_topic", "author",
        "published_date", "language", "scraper", "_scrape_run_id", "_scraped_at",
        "_run_timestamp", "doc_id",
        _sentiment_answer(F.col("_stance")).alias("sentiment_answer"),
        _esg_answer(F.col("source_type")).alias("esg_answer"),
        _claims_answer().alias("claims_answer"),
        _event_answer().alias("event_answer"),
    )


def run_log_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows from ``events``: per (event_type, day) counts plus a ``total`` row per day.

    ``total`` is the number of distinct events of the day (post-dedupe semantics),
    per-type rows are raw counts — the same shape the scraper writes.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    day = F.to_timestamp(F.date_trunc("day", F.col("ts")))
    per_type = ev.groupBy(F.col("event_type").alias("source_type"), day.alias("run_ts")).agg(
        F.count(F.lit(1)).alias("count"))
    total = ev.groupBy(day.alias("run_ts")).agg(F.count_distinct("event_id").alias("count")) \
        .select(F.lit("total").alias("source_type"), "count", "run_ts")
    return per_type.select("source_type", "count", "run_ts").unionByName(total)
