"""Building-block queries: single operators from SURVEY §2 run over whole driver tables.

These give each grouped/windowed/scalar building block its own checked
query (aggregates over ``events``, cleaning over ``pages``, dedupe and run
statistics over the fixture landing frame, rule stand-ins over
``documents``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions import prompts as P
from pulse.functions import json as J
from pulse.functions.labels import alignment_band, sentiment_bucket
from pulse.functions.agg import avg_round, median
from pulse.functions.text import clean_text, preview
from pulse.operators import enrich as K
from pulse.operators import ingest as I
from pulse.operators.clean import expectation_report
from pulse.operators.filters import first_per_key
from pulse.operators.quantiles import grouped_median
from pulse.plans import datasets as L
from pulse.plans import driver_tables as FP
from pulse.sources.tables import spread_scan


def audit_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, as a single job (no driver loop)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_health(spark, sf):
    """The row counts of the pipeline's tables, over one stored silver."""
    silver = FP.stored_silver(spark, sf)
    ins = FP.insights_of(FP.scored_of(silver))
    return audit_counts({"silver_articles": silver, "article_insights": ins, "claims": FP.claims_of(ins),
                         "news_events": FP.events_of(ins)})


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clean_pages(spark, sf):
    """C3/C4 over raw web pages."""
    p = spread_scan(_t(spark, sf, "pages"))
    return p.select("page_id", clean_text("html").alias("clean_content"),
                    preview("html").alias("content_preview"),
                    F.length(clean_text("html")).cast("long").alias("clean_chars"))


def events_median(spark, sf, accuracy: int | None = None):
    """E6/E3/E1 median, mean and count per event type and day.

    ``value`` is continuous and one (type, day) group may hold a large share of
    the events, so the exact median is that of ``grouped_median`` (sketch bounds and a second scan)
    rather than ``percentile``'s per-group value map.
    ``accuracy`` switches to the fixed-size ``percentile_approx`` sketch."""
    e = _t(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    keys = ["event_type", "day"]
    if accuracy is not None:
        return e.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), avg_round("value", 4).alias("avg_value"),
            F.round(median("value", accuracy), 4).alias("median_value"))
    stats = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 avg_round("value", 4).alias("avg_value"))
    med = grouped_median(e, keys, "value", "median_value")
    return L._null_safe_join(stats, med, keys).select(
        *keys, "n", "avg_value", F.round("median_value", 4).alias("median_value"))


def events_distinct(spark, sf):
    """Several COUNT(DISTINCT) per group + MAX."""
    e = _t(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("event_type").alias("event_types"),
        F.max("value").alias("max_value"))


def events_top5(spark, sf):
    """top-5 by value per event type (ties by event id), then ordered list."""
    e = _t(spark, sf, "events").select("event_type", "event_id", "value")
    top = L.top_k_per_group(e, ["event_type"], [F.col("value").desc_nulls_last(),
                                                F.col("event_id").asc()], 5)
    return top.groupBy("event_type").agg(
        L.ordered_join(F.col("event_id").cast("string"), F.col("_rn"), ";").alias("top_ids"))


def events_latest_per_user(spark, sf):
    """latest event per user (row_number desc)."""
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return first_per_key(e, ["user_id"], [F.col("ts"), F.col("event_id")], latest=True)


def events_props(spark, sf):
    """JSON field extraction from text props, grouped."""
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def events_pivot_counts(spark, sf):
    """Conditional counts per calendar week (Monday weeks)."""
    e = _t(spark, sf, "events")
    return e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        *[F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).alias(t)
          for t in ["signup", "purchase", "error", "click", "view"]],
        avg_round(F.when(F.col("event_type") == "purchase", F.col("value")), 4)
        .alias("avg_purchase"))


def landing_dedupe(spark, sf):
    """Keep the first record per URL (phase order, then record order)."""
    lan = FP.landing(spark, sf)
    return I.dedupe_first(lan, order=[F.col("_scraped_at"), F.col("doc_id")]) \
        .select("url", "article_id", "doc_id", "source_type")


def landing_run_stats(spark, sf):
    """Per-source pre-dedupe counts + post-dedupe total."""
    lan = FP.landing(spark, sf)
    ded = I.dedupe_first(lan, order=[F.col("_scraped_at"), F.col("doc_id")])
    return I.run_stats(lan, ded, run_ts="2024-04-30 04:00:00").select(
        "source_type", "count")


def feed_items(spark, sf):
    """B9 then B8: first 20 items per feed, then the feed's keyword filter."""
    docs = _t(spark, sf, "documents")
    items = docs.select(F.col("source").alias("feed_name"),
                        F.col("doc_id").alias("item_no"),
                        F.substring("text", 1, 80).alias("title"),
                        F.col("text").alias("summary"))
    feeds = I.feed_dimension(spark, FEED_DIM)
    capped = I.cap_per_feed(items, n=20, order=[F.col("item_no").asc()])
    return I.feed_filter(capped, feeds).select("feed_name", "item_no")


def feed_item_rows(spark, sf):
    """Landed-feed-shaped items from ``documents`` (one per document, whole text):
    missing/blank links, summary-or-description bodies with markup, and date
    texts in RFC-822, ISO or unparseable form (fixture rules in FIXTURES.md §5)."""
    d = _t(spark, sf, "documents")
    D = F.col("doc_id")
    day = F.lpad((D % 28 + 1).cast("string"), 2, "0")
    blank_or_null = lambda k, m, v: (F.when(D % m == k, F.lit("")).when(D % m == k + 1, F.lit(None))
                                     .otherwise(v))
    return d.select(
        F.col("source").alias("feed_name"), D.alias("item_no"),
        blank_or_null(4, 9, F.concat(F.lit("https://feeds.example.org/i/"), D.cast("string"))).alias("link"),
        F.when(D % 7 == 0, F.lit(None)).otherwise(F.substring("text", 1, 80)).alias("title"),
        blank_or_null(0, 6, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>\n"))).alias("summary"),
        F.when(D % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("<div class=\"d\">"), F.col("text"), F.lit("</div>"))).alias("description"),
        F.when(D % 11 == 0, F.lit(None)).otherwise(F.col("source")).alias("author"),
        blank_or_null(0, 5, F.concat(F.lit("Mon, "), day, F.lit(" Apr 2024 10:00:00 +0000"))).alias("pubDate"),
        F.when(D % 3 == 0, F.concat(F.lit("2024-03-"), day, F.lit("T08:30:00"))).alias("updated"),
        F.lit("yesterday").alias("created"))


def feed_normalised(spark, sf):
    """Feed items → article rows, with the parsed publication day."""
    n = I.normalise_feed(feed_item_rows(spark, sf))
    return n.select("feed_name", "item_no", "url", "title", "content", "author", "published_date",
                    F.to_date(I.feed_date("published_date")).alias("published_day"))


# Feed dimension of the feed-filter block: (feed, keywords); an empty list passes all.
FEED_DIM = [(f"src{i}", (["the", "und"] if i % 3 == 0 else (["de"] if i % 3 == 1 else [])))
            for i in range(20)]


def topic_families(spark, sf):
    """Strategy-vs-crisis topic counts over the landing frame."""
    return I.topic_family_counts(FP.landing(spark, sf))


def silver_quality(spark, sf):
    """C11: warn-only expectation report over cleaned articles."""
    return expectation_report(FP.silver(spark, sf))


def daily_topics(spark, sf):
    """Topic mentions per day (explode + count instead of a flattened bag)."""
    return L.daily_topics(FP.insights(spark, sf))


def prompt_hashes(spark, sf):
    """Prompt assembly (sentiment, ESG, event) as SHA-256 per article."""
    s = FP.insights(spark, sf)
    return s.select("article_id", "url", "scraped_date",
                    F.sha2(P.sentiment_prompt(), 256).alias("sentiment_prompt"),
                    F.sha2(P.esg_prompt(), 256).alias("esg_prompt"),
                    F.sha2(P.event_prompt(), 256).alias("event_prompt"),
                    F.sha2(P.claims_prompt(), 256).alias("claims_prompt"),
                    F.length(P.claims_prompt()).cast("long").alias("claims_prompt_chars"))


def delta_prompts(spark, sf):
    """The comparison's full and quick prompts as SHA-256 per claims theme and sentiment row."""
    c, weekly = FP.delta_inputs(spark, sf)
    stats = L._null_safe_join(L.claim_summary(c), L.claim_digest(c), L.THEME)
    j = L.join_claims_sentiment(stats, L.sentiment_window(weekly, FP.AS_OF))
    return j.select("esg_category", "sub_theme", "latest_week", "total_articles",
                    F.sha2(P.delta_prompt(), 256).alias("delta_prompt"),
                    F.sha2(P.quick_alignment_prompt(), 256).alias("quick_prompt"))


def summary_prompts(spark, sf):
    """The daily brief's and headline's prompts as SHA-256 per day."""
    ins = FP.insights(spark, sf)
    day = FP.daily(spark, sf).join(L.headline_digest(ins), "report_date", "left")
    return day.select("report_date", F.sha2(P.brief_prompt(), 256).alias("brief_prompt"),
                      F.sha2(P.headline_prompt(), 256).alias("headline_prompt"))


def display_labels(spark, sf):
    """The dashboards' sentiment label (threshold 0.1, NULL shown as unknown)."""
    return FP.insights(spark, sf).select(
        "article_id", "url", "scraped_date",
        sentiment_bucket("sentiment_score", 0.1, unknown="unknown").alias("display_label"))


def alignment_bands(spark, sf):
    """The alignment band of every claims-versus-sentiment row."""
    return FP.delta(spark, sf).select("delta_id", "esg_category", "sub_theme", "latest_week",
                                      alignment_band("alignment_score_quick").alias("band"))


def fenced_answers(spark, sf):
    """Answers read through their Markdown fence, with a fallback where none parses."""
    answer = J.parse_sentiment("sentiment_json_raw", fenced=True)
    return FP.insights(spark, sf).select(
        "article_id", "url", "scraped_date", F.coalesce(answer["sentiment"], F.lit("unparsed")).alias("answer_label"))


def claim_fields(spark, sf):
    """The fields of every rule-made claim of every document."""
    d = spread_scan(_t(spark, sf, "documents").select("doc_id", "text"))
    claims = d.withColumn("claims", J.parse_claims(K.rule_claims("text")(d)))
    return claims.select("doc_id", F.posexplode("claims").alias("position", "c")).select(
        "doc_id", "position", "c.claim_text", "c.metric", "c.timeframe", "c.claim_type")


# Answers of earlier runs cover the articles dated before this day (D6 block).
CACHE_CUTOVER = "2024-03-15"


def pending_sentiment_prompts(spark, sf):
    """The distinct sentiment prompts of the scoring candidates that the answer
    cache (the earlier runs' prompts) has not answered: the model's work list."""
    s = FP.scored(spark, sf)
    prompt = P.sentiment_prompt()
    prompts = s.select(K.prompt_hash(prompt).alias("prompt_hash"), prompt.alias("prompt"))
    cache = s.where(F.col("scraped_date") < F.lit(CACHE_CUTOVER).cast("date")).select(
        K.prompt_hash(prompt).alias("prompt_hash"))
    return K.pending_prompts(prompts, cache).select(
        "prompt_hash", F.length("prompt").cast("long").alias("prompt_chars"))


def lexicon_sentiment(spark, sf):
    """K12 stand-in over every document."""
    d = spread_scan(_t(spark, sf, "documents").select("doc_id", "text"))
    return K.lexicon_scores(d, "doc_id", "text").select("doc_id", F.round("score", 4).alias("score"))


def keyword_categories(spark, sf):
    """K13 stand-in: category with most keyword hits per document."""
    d = spread_scan(_t(spark, sf, "documents").select("doc_id", "text"))
    return K.keyword_classes(d, "doc_id", "text", K.CATEGORY_KEYWORDS, "Not-ESG", "esg_category")


def claim_rules(spark, sf):
    """K14 stand-in: candidate claim sentences per benchmark passage."""
    b = _t(spark, sf, "benchmark")
    return b.select("item_id", F.size(K.claim_sentences("text")).cast("long").alias("claims"))


def block_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a18_audit_counts": lambda s, sf: audit_counts({
            "documents": _t(s, sf, "documents"), "labels": _t(s, sf, "labels"),
            "pages": _t(s, sf, "pages"), "events": _t(s, sf, "events")}),
        "b04_dedupe_first": landing_dedupe,
        "b06_run_stats": landing_run_stats,
        "b08_feed_filter": feed_items,
        "b10_normalise_feed": feed_normalised,
        "b16_topic_families": topic_families,
        "c03_clean_pages": clean_pages,
        "c11_expectation_report": silver_quality,
        "e02_count_distinct": events_distinct,
        "e05_pivot_counts": events_pivot_counts,
        "e06_median_by_group": events_median,
        "e14_daily_topics": daily_topics,
        "f03_top5_per_group": events_top5,
        "f05_latest_per_key": events_latest_per_user,
        "i20_json_fields": events_props,
        "d06_pending_prompts": pending_sentiment_prompts,
        "k10_prompts": prompt_hashes,
        "k10_summary_prompts": summary_prompts,
        "k10_delta_prompts": delta_prompts,
        "i22_fenced_answers": fenced_answers,
        "i24_display_labels": display_labels,
        "i25_alignment_bands": alignment_bands,
        "k14_claim_fields": claim_fields,
        "k12_lexicon_sentiment": lexicon_sentiment,
        "k13_keyword_category": keyword_categories,
        "k14_claim_rules": claim_rules,
    }


# ---------------------------------------------------------------------------
# Ingest blocks over documents-derived records
# ---------------------------------------------------------------------------
def _doc_records(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("https://web.example.org/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.substring("text", 1, 30)).alias("title"),
        F.col("text").alias("content"), F.col("source").alias("source_type"),
        F.lit("esg_news").alias("search_topic"), "doc_id")


def envelope_records(spark, sf):
    """Record envelope (uuid5 id, URL hash, length, defaults)."""
    e = I.envelope(_doc_records(spark, sf))
    return e.select("doc_id", "article_id", "url_hash", "content_length", "language", "author")


def stamped_records(spark, sf):
    """A run stamps its id and time on records that lack them (records carried
    over from an earlier run keep theirs); every record gets the run timestamp."""
    D = F.col("doc_id")
    r = _doc_records(spark, sf).select(
        "doc_id", "url",
        F.when(D % 3 == 0, F.lit(None)).otherwise(F.lit("run-20240429")).alias("_scrape_run_id"),
        F.when(D % 4 == 1, F.lit(None)).otherwise(F.lit("2024-04-29T04:00:00Z")).alias("_scraped_at"))
    return I.stamp_run(r, "run-20240430", "2024-04-30T04:00:00Z").select(
        "doc_id", "_scrape_run_id", "_scraped_at", "_run_timestamp")


def gated_bodies(spark, sf):
    """Body gate ≥ 80 chars, 20 000-char cut, title defaults to the URL."""
    g = I.gate_body(_doc_records(spark, sf))
    return g.select("url", "title", F.length("content").cast("long").alias("body_chars"))


# Direct-URL metadata of the URL-lookup block: (url, source_type, topic).
DIRECT_URLS = [("https://news.example.org/a/10", "official", "strategy"),
               ("https://news.example.org/a/20", "benchmark", "wba_index"),
               ("https://news.example.org/a/30", "ngo", "human_rights"),
               ("https://news.example.org/a/40", "official", "annual_report"),
               ("https://news.example.org/a/50", "news", "esg_news")]


def url_meta(spark, sf):
    """URL → (source_type, topic) lookup with the (official, direct_fetch) default."""
    urls = spark.createDataFrame(DIRECT_URLS, "url STRING, source_type STRING, topic STRING")
    lan = FP.landing(spark, sf).select("url", "doc_id")
    return I.attach_url_meta(lan, urls).select("doc_id", "url", "source_type", "search_topic")


def _responses(spark, sf):
    d = spread_scan(_t(spark, sf, "documents"))
    did = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("WEB RESULTS:\n\nTitle: T"), did, F.lit("\nURL: https://web.example.org/d/"), did,
        F.lit("\nPublished: 2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
        F.lit("\nSnippets:\n- "), F.regexp_replace(F.substring("text", 1, 120), r"\s+", " "),
        F.lit("\n\nContent:\n"), F.col("text"),
        F.lit("\nNEWS RESULTS:\nTitle: N"), did, F.lit("\nURL: https://news.example.org/n/"), did,
        F.lit("\nDescription: "), F.regexp_replace(F.substring("text", 1, 100), r"\s+", " "),
        F.lit("\n"))
    return d.select(F.lit("esg_news").alias("topic"), F.col("source").alias("source_type"),
                    F.concat(F.lit("q"), did).alias("query"), text.alias("text"))


def search_results(spark, sf):
    """Search responses (two result blocks per document) → records."""
    from pulse.operators.search_text import explode_search_results
    return explode_search_results(_responses(spark, sf))


def url_contents(spark, sf):
    """Page-contents responses (one URL block per document) → records."""
    from pulse.operators.search_text import explode_url_contents
    d = spread_scan(_t(spark, sf, "documents"))
    did = F.col("doc_id").cast("string")
    text = F.concat(F.lit("URL: https://web.example.org/c/"), did, F.lit("\nTitle: C"), did,
                    F.lit("\nContent:\n"), F.col("text"), F.lit("\n"))
    return explode_url_contents(d.select(text.alias("text")))


def adhoc(spark, sf):
    """A read-only SELECT over a published view (≤ 50 rows)."""
    from pulse.sources.tables import adhoc_select
    return adhoc_select(spark, {"article_insights": FP.insights(spark, sf)},
                        "SELECT esg_category, COUNT(*) AS n, MAX(scraped_date) AS latest "
                        "FROM article_insights GROUP BY esg_category")


def ingest_block_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a19_adhoc_select": adhoc,
        "b01_envelope": envelope_records,
        "b07_stamp_run": stamped_records,
        "b11_search_results": search_results,
        "b12_url_contents": url_contents,
        "b13_url_meta": url_meta,
        "b14_gate_body": gated_bodies,
    }


# ---------------------------------------------------------------------------
# Streaming: landing files → bronze stream → silver stream → table
# ---------------------------------------------------------------------------
def _shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    import uuid
    from pulse.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/pulse-{name}-{uuid.uuid4().hex[:12]}"


def streamed_silver(spark, sf):
    """The fixture's landing records written as JSON-lines files in two
    batches, ingested by two triggered bronze runs and one silver run; the silver
    table is read back.  Equals the batch silver definition over the same records."""
    from pulse.operators.ingest import to_landing
    from pulse.sources.tables import read_table, write_landing
    from pulse.streaming.incremental import run_bronze_stream, run_silver_stream
    root = _shared_scratch(spark, "stream")
    lan = to_landing(FP.landing(spark, sf))
    half = F.col("_scraped_at") < F.lit("2024-03-01")
    write_landing(lan.where(half), f"{root}/landing")
    run_bronze_stream(spark, f"{root}/landing", f"{root}/bronze", f"{root}/ck_bronze")
    write_landing(lan.where(~half | F.col("_scraped_at").isNull()), f"{root}/landing")
    run_bronze_stream(spark, f"{root}/landing", f"{root}/bronze", f"{root}/ck_bronze")
    run_silver_stream(spark, f"{root}/bronze", f"{root}/silver", f"{root}/ck_silver")
    return read_table(spark, f"{root}/silver").select(
        "article_id", "url", "url_hash", "clean_content", "content_preview", "content_length",
        "title", "published_at", "scraped_date", "source_type", "search_topic", "esg_hint",
        "language")


def streaming_block_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"j01_streamed_silver": streamed_silver}


def rule_insights(spark, sf):
    """K2/K3 offline: silver articles scored and classified by the rule stand-ins
    (K12 lexicon sentiment, K13 keyword category) through the JSON answer path."""
    from pulse.operators.enrich import RuleResponder, rule_esg, rule_sentiment
    scored = L.scored_articles(FP.silver(spark, sf), RuleResponder(rule_sentiment()),
                               keep=["doc_id"])
    ins = L.article_insights(scored, RuleResponder(rule_esg()), keep=["doc_id"])
    return ins.select("doc_id", "url", "scraped_date", "sentiment_label", "sentiment_score",
                      "stance", "esg_category", "credibility_score", "is_official_csr")


def offline_block_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"k12_rule_insights": rule_insights}
