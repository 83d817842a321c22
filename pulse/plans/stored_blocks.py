"""Queries over state that runs leave behind: indexes, layouts, rollups, known URLs, answers, metrics, refused rows.

Each query writes its state under the shared folder from the whole driver tables, as the jobs do, and reads its
result from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators import ingest as I
from pulse.operators.keyword_index import feed_filter_indexed, keyword_index, open_feeds
from pulse.operators.known_urls import keep_new
from pulse.operators.pages import RankIndex, in_order, write_ranked
from pulse.operators.quarantine import judged_articles, refused, write_judged
from pulse.operators.title_index import TitleIndex, write_title_index
from pulse.plans import blocks as B
from pulse.plans import dashboard as M
from pulse.plans import datasets as L
from pulse.plans import driver_tables as FP
from pulse.plans.ingest import ingest_day
from pulse.plans.rollups import DailyRollup, refresh_daily, refresh_weekly
from pulse.sources.layout import write_clustered
from pulse.sources.store import shared_folder, stored
from pulse.streaming.enrichment import enrich_resumable
from pulse.streaming.incremental import run_bronze_stream, run_silver_stream
from pulse.streaming.metrics import MetricsTable, read_metrics, totals

RANGES = 16
DAY = "2024-04-30T04:00:00Z"


def _ranges(spark: SparkSession) -> int:
    return max(RANGES, spark.sparkContext.defaultParallelism)


# ---------------------------------------------------------------------------
# K1 resumable enrichment
# ---------------------------------------------------------------------------
def _stand_in(prompts: list[str]) -> list[str]:
    """An offline model: a digest of the prompt."""
    return [hashlib.sha256(p.encode()).hexdigest()[:16] for p in prompts]


def resumable_answers(spark, sf):
    """K1: every article's prompt answered through the committed work list; a second run finds all answered."""
    ins = FP.insights(spark, sf).select("article_id", "url", "scraped_date", "source_type", "search_topic", "title")
    ins = stored(ins, "articles")
    prompt = F.concat_ws("|", "source_type", "search_topic", "title")
    store = shared_folder(spark, "answers")
    enrich_resumable(ins, prompt, _stand_in, store, prompts_per_file=200)
    return enrich_resumable(ins, prompt, _stand_in, store, prompts_per_file=200).select(
        "article_id", "url", "scraped_date", "answer")


# ---------------------------------------------------------------------------
# G1 deep pages
# ---------------------------------------------------------------------------
def deep_events(spark, sf):
    """G1: events 5000 to 5049 of the newest first, through a rank index."""
    ev = B._t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    path = shared_folder(spark, "event-ranks")
    write_ranked(ev, path, [F.col("ts").desc_nulls_last(), F.col("event_id").asc()], _ranges(spark))
    return in_order(RankIndex(spark, path).page(5000, 50))


def _explore_index(spark, sf) -> RankIndex:
    path = shared_folder(spark, "explore-ranks")
    M.write_explore_index(FP.insights(spark, sf), path, _ranges(spark))
    return RankIndex(spark, path)


def deep_explore(spark, sf):
    """G1/M1: the explorer's page at offset 500, through its rank index."""
    return M.explore_indexed(_explore_index(spark, sf), limit=50, offset=500)


def deep_explore_filtered(spark, sf):
    """G1/M1 with filters: ranks are those of the matching rows."""
    return M.explore_indexed(_explore_index(spark, sf), limit=20, offset=40, esg_category="Social", date_from="2024-01-15")


def deep_events_page(spark, sf):
    """The events page at offset 10, through a rank index in the events' order."""
    path = shared_folder(spark, "news-ranks")
    write_ranked(FP.events(spark, sf).select(*M.EVENT_PAGE_COLS), path, M.events_order(), _ranges(spark))
    return M.events_page_indexed(RankIndex(spark, path), days=90, limit=50, offset=10, as_of=FP.AS_OF)


# ---------------------------------------------------------------------------
# A14 clustered layout, C18 title search
# ---------------------------------------------------------------------------
CLUSTER = ["source_type", "search_topic", "scraped_date"]


def clustered_silver(spark, sf):
    """Silver rewritten in a clustered layout; the rows are those of silver."""
    cols = ["article_id", "url", "url_hash", "clean_content", "content_preview", "content_length", "title", "published_at",
            "scraped_date", "source_type", "search_topic", "esg_hint", "language"]
    path = shared_folder(spark, "clustered")
    write_clustered(stored(FP.silver(spark, sf).select(*cols), "silver"), path, CLUSTER, _ranges(spark))
    return spark.read.parquet(path)


def title_search(spark, sf):
    """The filtered explorer page whose title search goes through the trigram index."""
    path = shared_folder(spark, "titles")
    cols = [c if isinstance(c, str) else "sentiment_score" for c in M._explore_cols()]
    write_title_index(FP.insights(spark, sf).select(*cols), path, M.explore_order(), _ranges(spark))
    return M.explore(TitleIndex(spark, path).search("The"), limit=20, offset=5, esg_category="Social",
                     date_from="2024-02-01", date_to="2024-04-30")


# ---------------------------------------------------------------------------
# A11/E2 refresh by runs
# ---------------------------------------------------------------------------
CUTOVER = "2024-03-01"


def _runs(spark, sf) -> list[tuple[str, DataFrame]]:
    """The articles of two landing batches; the first is delivered twice (a retried run)."""
    ins = stored(FP.insights(spark, sf).select(
        "url", "content_preview", "source_type", "esg_category", "esg_sub_theme", "sentiment_label", "sentiment_score", "stance",
        "credibility_score", "scraped_date", "scraped_at"), "articles")
    early = F.coalesce(F.col("scraped_at") < F.lit(CUTOVER).cast("timestamp"), F.lit(False))
    return [("run-1", ins.where(early)), ("run-1", ins.where(early)), ("run-2", ins.where(~early))]


def incremental_weekly(spark, sf):
    """Weekly sentiment from per-run partial aggregates, only touched weeks rewritten."""
    root = shared_folder(spark, "weekly")
    for run, rows in _runs(spark, sf):
        refresh_weekly(rows, root, run)
    return spark.read.parquet(f"{root}/weekly_sentiment").select(
        "period_key", *L.WEEK_KEYS, "article_count", "avg_sentiment_score", "median_sentiment_score", "positive_count",
        "neutral_count", "negative_count", "critical_count", "supportive_count", "pct_critical", "overall_sentiment_label",
        F.array_join(F.transform("top_evidence", lambda x: x["url"]), ";").alias("top_evidence_urls"),
        F.array_join(F.transform("top_evidence", lambda x: F.coalesce(x["score"].cast("string"), F.lit("null"))), ";")
        .alias("top_evidence_scores"))


def _rollup(spark, sf) -> DailyRollup:
    root = shared_folder(spark, "daily")
    for run, rows in _runs(spark, sf):
        refresh_daily(rows, root, run)
    return DailyRollup(spark, root)


def incremental_daily(spark, sf):
    """Daily statistics from per-run partials; distinct URLs from bitmaps."""
    return _rollup(spark, sf).stats()


def kpis_from_days(spark, sf):
    """The KPI row of a range of days, read from day rows."""
    return _rollup(spark, sf).kpis(date_from="2024-01-15")


# ---------------------------------------------------------------------------
# H2/F5 keep-first across runs, B8 large keyword dimensions, C10 quarantine
# ---------------------------------------------------------------------------
def first_across_runs(spark, sf):
    """Three landing batches, each keeping the URLs that no earlier one has kept."""
    store = shared_folder(spark, "known-urls")
    lan = stored(FP.landing(spark, sf).select("url", "doc_id", "source_type", "_scraped_at"), "landing")
    batch = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") % 3).otherwise(F.col("doc_id") % 2)
    out = None
    for k in range(3):
        run = f"run-{k}"
        kept = keep_new(lan.where(batch == k), [F.col("_scraped_at"), F.col("doc_id")], store, run, blocks=64)
        kept = kept.select("url", "doc_id", "source_type", F.lit(run).alias("run"))
        out = kept if out is None else out.unionByName(kept)
    return out


def many_keywords(spark, sf):
    """Pages filtered by every distinct word pair of the benchmark, through the keyword index."""
    items = B._t(spark, sf, "pages").select(F.lit("web").alias("feed_name"), F.col("page_id").alias("item_no"),
                                            F.col("url").alias("title"), F.col("html").alias("summary"))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                        lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))
    said = B._t(spark, sf, "benchmark").where(F.size(words) > 1).select(F.explode(pairs).alias("keyword"))
    # a feed's own row holds its keywords; this one feed has them all
    feeds = said.where(F.length("keyword") >= 12).distinct().groupBy(F.lit("web").alias("feed_name")).agg(
        F.collect_set("keyword").alias("filter_keywords"))
    return feed_filter_indexed(items, keyword_index(feeds), open_feeds(feeds)).select("feed_name", "item_no")


def quarantined(spark, sf):
    """The refused articles with the rules they break."""
    path = shared_folder(spark, "judged")
    write_judged(judged_articles(FP.bronze(spark, sf), keep=["doc_id"]), path)
    return refused(spark, path).select("doc_id", "url", "source_type", F.length("clean_content").cast("long").alias("clean_chars"),
                                       F.array_join("broken_rules", ",").alias("broken_rules"),
                                       F.array_join("warnings", ",").alias("warnings"))


# ---------------------------------------------------------------------------
# J5 stored metrics
# ---------------------------------------------------------------------------
def stored_metrics(spark, sf):
    """The silver stream's rule violations, added up from the metrics table that its batches wrote."""
    root = shared_folder(spark, "metrics")
    I.to_landing(FP.landing(spark, sf)).write.json(f"{root}/landing")
    run_bronze_stream(spark, f"{root}/landing", f"{root}/bronze", f"{root}/ck_bronze")
    with MetricsTable(spark, f"{root}/progress"):
        run_silver_stream(spark, f"{root}/bronze", f"{root}/silver", f"{root}/ck_silver")
    return totals(read_metrics(spark, f"{root}/progress").where(F.col("name") != ""))


# ---------------------------------------------------------------------------
# the daily ingest
# ---------------------------------------------------------------------------
def _day(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(landing records, run log): URLs are found by up to three responses, by two page reads, and by both."""
    d = B._t(spark, sf, "documents")
    doc, did = F.col("doc_id"), F.col("doc_id").cast("string")
    # collected from the last document to the first
    place = lambda name: F.struct(F.lit(name).alias("file"), (F.lit(1 << 40) - doc).alias("row")).alias("position")
    url = F.concat(F.lit("https://day.example.org/d/"), (doc - doc % 3).cast("string"))
    text = F.concat(F.lit("WEB RESULTS:\n\nTitle: T"), did, F.lit("\nURL: "), url, F.lit("\nPublished: 2024-03-"),
                    F.lpad((doc % 28 + 1).cast("string"), 2, "0"), F.lit("\nSnippets:\n- "),
                    F.regexp_replace(F.substring("text", 1, 120), r"\s+", " "), F.lit("\n\nContent:\n"), F.col("text"), F.lit("\n"))
    responses = d.select(F.lit("esg_news").alias("topic"), F.col("source").alias("source_type"),
                         F.concat(F.lit("q"), did).alias("query"), text.alias("text"), place("responses"))
    page = F.when(doc % 10 == 0, url).otherwise(F.concat(F.lit("https://day.example.org/p/"), (doc - doc % 2).cast("string")))
    contents = d.select(F.concat(F.lit("URL: "), page, F.lit("\nTitle: C"), did, F.lit("\nContent:\n"), F.col("text"),
                                 F.lit("\n")).alias("text"), place("pages"))
    urls = spark.createDataFrame([("https://day.example.org/p/4", "official", "strategy"),
                                  ("https://day.example.org/p/8", "ngo", "human_rights")],
                                 "url STRING, source_type STRING, topic STRING")
    feeds = I.feed_dimension(spark, B.FEED_DIM)
    return ingest_day(responses, contents, B.feed_item_rows(spark, sf), feeds, urls, "run-20240430", DAY)


def daily_landing(spark, sf):
    """The day's landing records: one per URL, the first collected."""
    records, _ = _day(spark, sf)
    return records.select("url", "title", "source_type", "search_topic", "author", "published_date", "content_length",
                          "scraper", "_scrape_run_id")


def daily_run_log(spark, sf):
    """The day's run log: one row per collector and the total after dedupe."""
    _, log = _day(spark, sf)
    return log.select("source_type", "count")


def stored_block_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a11_incremental_weekly": incremental_weekly,
        "a11_incremental_daily": incremental_daily,
        "a14_clustered_silver": clustered_silver,
        "b08_many_keywords": many_keywords,
        "c10_quarantine": quarantined,
        "c18_title_search": title_search,
        "e02_kpis_from_days": kpis_from_days,
        "g01_deep_events": deep_events,
        "g01_deep_explore": deep_explore,
        "g01_deep_explore_filtered": deep_explore_filtered,
        "g01_deep_events_page": deep_events_page,
        "h02_first_across_runs": first_across_runs,
        "j05_stored_metrics": stored_metrics,
        "k01_resumable_answers": resumable_answers,
        "l00_daily_landing": daily_landing,
        "l00_daily_run_log": daily_run_log,
    }
