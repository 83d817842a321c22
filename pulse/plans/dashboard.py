"""Dashboard queries (M-series) and dashboard-side shaping (N-series).

Each function maps gold DataFrames + bound parameters to one result
DataFrame.  Every ORDER BY that feeds a LIMIT ends with a unique tie-break so
results are deterministic.  Grouped queries are one hash aggregate each; the
top-N queries plan as TakeOrderedAndProject (per-partition top-N, then merge).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import json as J
from pulse.functions.agg import avg_round, avg_round_if, sum_if
from pulse.functions.dates import as_date_lit, period, since
from pulse.functions.labels import risk_from_rank, risk_rank, severity_rank
from pulse.operators.filters import apply_filters, cap_per_group, clamp, count_rows, few_sorted, page, top_n
from pulse.operators.pages import RankIndex, in_order, write_ranked
from pulse.plans.datasets import newest_first, ordered_join
from pulse.schemas import OFFICIAL_SOURCES, PUBLIC_SPLIT_SOURCES, SEVERITY_ORDER

# The largest page and offset a dashboard request may ask for.
MAX_PAGE, MAX_OFFSET = 200, 10_000_000


def _tiebreak() -> list[Column]:
    """Unique tie-break for article rows (a URL seen in two runs differs in publish time)."""
    return [F.col("article_id").asc_nulls_last(), F.col("url").asc_nulls_last(),
            F.col("published_at").asc_nulls_last()]


_sum_if = sum_if
_avg_r = avg_round
_avg_if_r = avg_round_if


# ---------------------------------------------------------------------------
# M1 explorer page (+ total)
# ---------------------------------------------------------------------------
def _explore_cols() -> list:
    return ["article_id", "url", "title", "content_preview", "source_type", "search_topic",
            "esg_category", "esg_sub_theme", "sentiment_label",
            F.round("sentiment_score", 3).alias("sentiment_score"), "stance",
            "credibility_score", "is_official_csr", "impact_summary", "scraped_date",
            "published_at", "language", "scraper"]


def _by_count(count: str, name: str) -> list:
    """Largest count first, then the name."""
    return [F.col(count).desc(), F.col(name).asc_nulls_last()]


def explore_filtered(insights: DataFrame, **filters) -> DataFrame:
    return apply_filters(insights, **filters)


def explore_order() -> list[Column]:
    return [F.col("scraped_date").desc_nulls_last(), F.col("credibility_score").desc_nulls_last(), *_tiebreak()]


def explore(insights: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    f = explore_filtered(insights, **filters)
    clamp(limit, 1, MAX_PAGE), clamp(offset, 0, MAX_OFFSET)
    return page(f, explore_order(), limit, offset).select(*_explore_cols())


def write_explore_index(insights: DataFrame, path: str, ranges: int) -> None:
    """The explorer's rank index: its columns in its order (``pages.write_ranked``)."""
    cols = [c if isinstance(c, str) else "sentiment_score" for c in _explore_cols()]
    write_ranked(insights.select(*cols), path, explore_order(), ranges)


def explore_indexed(index: RankIndex, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """M1 at any depth: ``explore`` through the rank index, reading only the ranges that the page covers."""
    clamp(limit, 1, MAX_PAGE)
    where = (lambda df: apply_filters(df, **filters)) if any(v not in (None, "") for v in filters.values()) else None
    got = index.page(offset, limit, where)
    return in_order(got.select(*_explore_cols(), "_range", "_pos"))


def explore_total(insights: DataFrame, **filters) -> DataFrame:
    return count_rows(explore_filtered(insights, **filters))


def page_envelope(page_df: DataFrame, total_df: DataFrame, limit: int, offset: int,
                  page_size: int = 20) -> dict:
    """The response envelope. Both inputs are bounded (≤ limit rows, 1 row)."""
    clamp(limit, 1, MAX_PAGE), clamp(offset, 0, MAX_OFFSET)
    page_df = page_df.limit(limit)
    total = total_df.first()[0]
    return {"total": total, "offset": offset, "limit": limit,
            "pages": -(-total // page_size), "items": [r.asDict() for r in page_df.collect()]}


# ---------------------------------------------------------------------------
# M2/M3 breakdowns
# ---------------------------------------------------------------------------
def category_breakdown(insights: DataFrame, date_from=None, date_to=None) -> DataFrame:
    f = apply_filters(insights.where(F.col("esg_category").isNotNull()
                                     & (F.col("esg_category") != "Not-ESG")),
                      date_from=date_from, date_to=date_to)
    return few_sorted(f.groupBy("esg_category").agg(
        F.count(F.lit(1)).alias("article_count"),
        _avg_r("sentiment_score", 3).alias("avg_sentiment"),
        _sum_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        _sum_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        _sum_if(F.col("stance") == "critical").alias("critical_count"),
        _avg_r("credibility_score", 1).alias("avg_credibility")),
                      *_by_count("article_count", "esg_category"))


def sub_themes(insights: DataFrame, esg_category=None, date_from=None, date_to=None,
               n: int = 30) -> DataFrame:
    f = apply_filters(insights.where(F.col("esg_sub_theme").isNotNull()),
                      esg_category=esg_category, date_from=date_from, date_to=date_to)
    g = f.groupBy("esg_category", "esg_sub_theme").agg(
        F.count(F.lit(1)).alias("article_count"),
        _avg_r("sentiment_score", 3).alias("avg_sentiment"))
    return top_n(g, [F.col("article_count").desc(), F.col("esg_category").asc_nulls_last(),
                     F.col("esg_sub_theme").asc()], n)


# ---------------------------------------------------------------------------
# M4–M6 sentiment
# ---------------------------------------------------------------------------
def sentiment_timeline(insights: DataFrame, granularity: str = "week", esg_category=None,
                       source_type=None, date_from=None, date_to=None) -> DataFrame:
    f = apply_filters(insights.where(F.col("sentiment_score").isNotNull()),
                      esg_category=esg_category, source_type=source_type,
                      date_from=date_from, date_to=date_to)
    return few_sorted(f.groupBy(period("scraped_date", granularity).alias("period")).agg(
        _avg_r("sentiment_score", 4).alias("avg_sentiment"),
        _avg_if_r(F.col("source_type").isin(OFFICIAL_SOURCES), "sentiment_score", 4)
        .alias("official_sentiment"),
        _avg_if_r(F.col("source_type").isin(PUBLIC_SPLIT_SOURCES), "sentiment_score", 4)
        .alias("public_sentiment"),
        F.count(F.lit(1)).alias("article_count"),
        _sum_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        _sum_if(F.col("sentiment_label") == "neutral").alias("neutral_count"),
        _sum_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        _sum_if(F.col("stance") == "critical").alias("critical_count")),
                      F.col("period").asc())


def sentiment_by_source(insights: DataFrame, date_from=None, date_to=None) -> DataFrame:
    f = apply_filters(insights.where(F.col("sentiment_score").isNotNull()),
                      date_from=date_from, date_to=date_to)
    return few_sorted(f.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("article_count"),
        _avg_r("sentiment_score", 4).alias("avg_sentiment"),
        _sum_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        _sum_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        _avg_r("credibility_score", 1).alias("avg_credibility")),
                      *_by_count("article_count", "source_type"))


def kpis(insights: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """A global aggregate — always exactly one row."""
    f = apply_filters(insights, date_from=date_from, date_to=date_to)
    return f.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_distinct("url").alias("unique_urls"),
        F.count_distinct("source_type").alias("source_types"),
        _avg_r("sentiment_score", 3).alias("overall_sentiment"),
        _avg_if_r(F.col("source_type").isin(OFFICIAL_SOURCES), "sentiment_score", 3)
        .alias("official_sentiment"),
        _avg_if_r(F.col("source_type").isin(PUBLIC_SPLIT_SOURCES), "sentiment_score", 3)
        .alias("public_sentiment"),
        _sum_if(F.col("stance") == "critical").alias("critical_articles"),
        F.count_distinct("esg_category").alias("esg_categories_covered"),
        F.max("scraped_date").alias("latest_scrape_date"))


# ---------------------------------------------------------------------------
# M7/M8 sources
# ---------------------------------------------------------------------------
def source_breakdown(insights: DataFrame, date_from=None, date_to=None) -> DataFrame:
    f = apply_filters(insights, date_from=date_from, date_to=date_to)
    return few_sorted(f.groupBy("source_type", "search_topic").agg(
        F.count(F.lit(1)).alias("article_count"),
        _avg_r("sentiment_score", 3).alias("avg_sentiment"),
        _avg_r("credibility_score", 1).alias("avg_credibility"),
        _sum_if(F.col("stance") == "critical").alias("critical_count"),
        _sum_if(F.col("stance") == "supportive").alias("supportive_count"),
        F.count_distinct("scraped_date").alias("active_days"),
        F.max("scraped_date").alias("last_seen")),
                      F.col("source_type").asc(), *_by_count("article_count", "search_topic"))


def coverage(insights: DataFrame, date_from=None, date_to=None) -> DataFrame:
    f = apply_filters(insights, date_from=date_from, date_to=date_to)
    return f.groupBy("scraped_date", "source_type").agg(F.count(F.lit(1)).alias("article_count")).orderBy(
        "scraped_date", "source_type")


def run_history(raw_log: DataFrame, limit: int = 30) -> DataFrame:
    """The ``total`` rows of the raw run log, newest first."""
    clamp(limit, 1, 100)
    t = raw_log.where(F.col("source_type") == "total").select(
        "source_type", F.col("count").cast("int").alias("record_count"), "run_ts")
    return top_n(t, [F.col("run_ts").desc_nulls_last(), F.col("record_count").desc()], limit)


# ---------------------------------------------------------------------------
# M9–M11 impact delta
# ---------------------------------------------------------------------------
def impact_delta_list(delta: DataFrame, esg_category=None, min_alignment=None,
                      max_alignment=None, risk_level=None) -> DataFrame:
    for bound in (min_alignment, max_alignment):
        if bound is not None:
            clamp(bound, 0, 10)
    f = apply_filters(delta, esg_category=esg_category, score_col="alignment_score_quick",
                      min_score=min_alignment, max_score=max_alignment)
    d = F.col("delta_json_raw")
    out = f.select(
        "delta_id", "esg_category", "sub_theme", "claim_count", "total_articles",
        F.round("period_avg_sentiment", 3).alias("period_avg_sentiment"),
        F.round("avg_pct_critical", 1).alias("pct_critical"),
        "dominant_sentiment", "alignment_score_quick", "latest_claim_date", "latest_week",
        "analysis_date",
        *[J.field(d, k).alias(k) for k in ["alignment_label", "gap_headline",
                                           "official_narrative", "public_narrative",
                                           "marketing_opportunity", "risk_level"]],
        "delta_json_raw")
    if risk_level:
        # Filter on the parsed field inside the plan (not after collecting).
        out = out.where(F.col("risk_level") == F.lit(risk_level))
    return out.orderBy(F.col("alignment_score_quick").asc_nulls_last(), "esg_category", "sub_theme", "delta_id",
                       "delta_json_raw")


def claims_list(claims_df: DataFrame, esg_category=None, claim_type=None,
                limit: int = 50) -> DataFrame:
    clamp(limit, 1, MAX_PAGE)
    f = apply_filters(claims_df.where(F.col("claim_text").isNotNull()),
                      esg_category=esg_category, claim_type=claim_type)
    order = [F.col("credibility_score").desc_nulls_last(), F.col("scraped_date").desc_nulls_last(),
             F.col("claim_id").asc_nulls_last(), F.col("published_at").asc_nulls_last()]
    return top_n(f, order, limit).select(
        "claim_id", "esg_category", "sub_theme", "claim_text", "metric", "timeframe",
        "claim_type", "credibility_score", "source_type", "url", "title", "scraped_date")


def delta_summary(delta: DataFrame, literal: bool = False) -> DataFrame:
    """M11. ``literal=True`` reproduces the reference's alphabetical MAX over the raw JSON
    text (T6); the default takes the highest-ranked risk level."""
    f = delta.where(F.col("alignment_score_quick").isNotNull())
    risk = J.field("delta_json_raw", "risk_level")
    max_risk = (J.field(F.max("delta_json_raw"), "risk_level") if literal
                else risk_from_rank(F.max(risk_rank(risk))))
    return few_sorted(f.groupBy("esg_category").agg(
        _avg_r("alignment_score_quick", 1).alias("avg_alignment"),
        F.count(F.lit(1)).alias("theme_count"),
        _sum_if(F.col("alignment_score_quick") <= 4).alias("divergent_themes"),
        max_risk.alias("max_risk_level")),
                      F.col("avg_alignment").asc(), "esg_category")


# ---------------------------------------------------------------------------
# M12–M15 news events
# ---------------------------------------------------------------------------
EVENT_PAGE_COLS = ["article_id", "url", "title", "content_preview", "source_type",
                   "search_topic", "scraped_date", "published_at", "sentiment_label",
                   "sentiment_score", "stance", "esg_category", "impact_summary",
                   "credibility_score", "event_type", "severity", "affected_region",
                   "affected_product", "financial_impact_estimate", "recommended_response"]


def _recent(events: DataFrame, days: int, as_of, cap: int) -> DataFrame:
    return events.where(F.col("scraped_date") >= since(days, as_of, cap))


def events_filtered(events: DataFrame, severity=None, event_type=None, days: int = 90,
                    as_of=None) -> DataFrame:
    return apply_filters(_recent(events, days, as_of, 365), severity=severity,
                         event_type=event_type)


def events_page(events: DataFrame, severity=None, event_type=None, days: int = 90,
                limit: int = 50, offset: int = 0, as_of=None) -> DataFrame:
    f = events_filtered(events, severity, event_type, days, as_of)
    clamp(limit, 1, MAX_PAGE), clamp(offset, 0, MAX_OFFSET)
    return page(f, events_order(), limit, offset).select(*EVENT_PAGE_COLS)


def events_order() -> list[Column]:
    return [severity_rank("severity").asc(), F.col("scraped_date").desc_nulls_last(),
            F.col("credibility_score").desc_nulls_last(), *_tiebreak()]


def events_page_indexed(index: RankIndex, severity=None, event_type=None, days: int = 90, limit: int = 50,
                        offset: int = 0, as_of=None) -> DataFrame:
    """M12 at any depth, through a rank index of the events in ``events_order``."""
    clamp(limit, 1, MAX_PAGE)
    got = index.page(offset, limit, lambda df: events_filtered(df, severity, event_type, days, as_of))
    return in_order(got.select(*EVENT_PAGE_COLS, "_range", "_pos"))


def events_total(events: DataFrame, severity=None, event_type=None, days: int = 90,
                 as_of=None) -> DataFrame:
    return count_rows(events_filtered(events, severity, event_type, days, as_of))


def events_by_severity(events: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    r = _recent(events, days, as_of, 365)
    return few_sorted(r.groupBy("severity").agg(F.count(F.lit(1)).alias("count")).select(
        F.coalesce("severity", F.lit("unknown")).alias("severity"), "count"),
                      severity_rank("severity").asc(), "severity")


def events_by_type(events: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    r = _recent(events, days, as_of, 365)
    return few_sorted(r.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("count"),
        _avg_r("sentiment_score", 3).alias("avg_sentiment")).select(
        F.coalesce("event_type", F.lit("other")).alias("event_type"), "count", "avg_sentiment"),
                      *_by_count("count", "event_type"))


def _top_regions(recent: DataFrame, n: int) -> DataFrame:
    g = recent.groupBy("affected_region").agg(
        F.count(F.lit(1)).alias("count"),
        _sum_if(F.col("severity").isin("critical", "high")).alias("critical_count"))
    return top_n(g, [F.col("count").desc(), F.col("affected_region").asc_nulls_first()], n)


def events_by_region(events: DataFrame, days: int = 30, as_of=None, n: int = 15) -> DataFrame:
    """Top regions by event count, with their critical/high event count.  The titles of these
    events are the child rows of ``region_headlines``."""
    top = _top_regions(_recent(events, days, as_of, 365), n)
    return few_sorted(top.select(F.coalesce("affected_region", F.lit("Unknown")).alias("region"), "count",
                      "critical_count"),
                      *_by_count("count", "region"))


def region_headlines(events: DataFrame, days: int = 30, as_of=None, n: int = 15) -> DataFrame:
    """Every critical/high title of the top regions, one row each."""
    r = _recent(events, days, as_of, 365)
    top = _top_regions(r, n).select(F.col("affected_region").alias("_top"))
    titles = r.where(F.col("severity").isin("critical", "high") & F.col("title").isNotNull())
    return titles.join(top, F.col("affected_region").eqNullSafe(F.col("_top")), "left_semi").select(
        F.coalesce("affected_region", F.lit("Unknown")).alias("region"), "scraped_date", "article_id", "title")


def events_timeline(events: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    r = _recent(events, days, as_of, 90)
    return few_sorted(r.groupBy("scraped_date").agg(
        F.count(F.lit(1)).alias("total"),
        *[_sum_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER],
        _avg_r("sentiment_score", 3).alias("avg_sentiment")),
                      "scraped_date")


def latest_critical(events: DataFrame, limit: int = 5, as_of=None) -> DataFrame:
    r = events.where(F.col("severity").isin("critical", "high")
                     & (F.col("scraped_date") >= since(14, as_of)))
    order = [F.when(F.col("severity") == "critical", 1).otherwise(2).asc(),
             F.col("scraped_date").desc_nulls_last(), *_tiebreak()]
    return top_n(r, order, limit).select(
        "article_id", "url", "title", "scraped_date", "severity", "event_type",
        "affected_region", "affected_product", "recommended_response", "sentiment_score",
        "impact_summary")


def has_alerts(latest: DataFrame) -> DataFrame:
    return latest.agg((F.count(F.lit(1)) > 0).alias("has_alerts"))


# ---------------------------------------------------------------------------
# M16–M20 reports
# ---------------------------------------------------------------------------
BRIEF_COLS = ["report_date", "total_articles", "unique_sources", "avg_sentiment",
              "positive_count", "neutral_count", "negative_count", "critical_count",
              "env_count", "social_count", "gov_count", "headline", "brief_json_raw"]


def daily_brief(summary: DataFrame, date=None, as_of=None) -> DataFrame:
    """The brief of ``date`` (default: as_of) if present, else the latest one — one plan."""
    want = as_date_lit(date or as_of)
    order = [(F.col("report_date") == want).desc_nulls_last(),
             F.col("report_date").desc_nulls_last()]
    return top_n(summary, order, 1).select(*BRIEF_COLS)


def parsed_brief(brief: DataFrame) -> DataFrame:
    """The brief's JSON as typed fields."""
    b = J.parse_brief(F.coalesce(F.col("brief_json_raw"), F.lit("{}")))
    return brief.select("report_date", b["headline"].alias("brief_headline"),
                        b["top_risk"].alias("top_risk"),
                        b["esg_pulse"]["environmental"].alias("pulse_environmental"),
                        b["esg_pulse"]["social"].alias("pulse_social"),
                        b["esg_pulse"]["governance"].alias("pulse_governance"),
                        F.array_join(b["recommended_actions"], " | ").alias("actions"))


def report_stats(insights: DataFrame, categories: list[str], date_from=None,
                 date_to=None) -> DataFrame:
    """Per category statistics; the credible impact summaries are the child rows of
    ``report_summaries``."""
    f = apply_filters(insights.where(F.col("esg_category").isin(categories)),
                      date_from=date_from, date_to=date_to)
    return f.groupBy("esg_category").agg(
        F.count(F.lit(1)).alias("article_count"),
        _avg_r("sentiment_score", 3).alias("avg_sentiment"),
        _sum_if(F.col("stance") == "critical").alias("critical_count"),
        _sum_if(F.col("stance") == "supportive").alias("supportive_count"),
        F.max("scraped_date").alias("latest_date")).orderBy(*_by_count("article_count", "esg_category"))


def report_summaries(insights: DataFrame, categories: list[str], date_from=None, date_to=None,
                     summary_chars: int = 250) -> DataFrame:
    """Every credible impact summary of the categories, one row each."""
    f = apply_filters(insights.where(F.col("esg_category").isin(categories)),
                      date_from=date_from, date_to=date_to)
    return f.where((F.col("credibility_score") >= 6) & F.col("impact_summary").isNotNull()).select(
        "esg_category", "scraped_date", "article_id", "url",
        F.left("impact_summary", F.lit(summary_chars)).alias("impact_summary"))


def report_claims(claims_df: DataFrame, categories: list[str], n: int = 15) -> DataFrame:
    f = claims_df.where(F.col("esg_category").isin(categories))
    order = [F.col("credibility_score").desc_nulls_last(), F.col("claim_id").asc_nulls_last(),
             F.col("published_at").asc_nulls_last()]
    return top_n(f, order, n).select("esg_category", "sub_theme", "claim_text", "metric",
                                     "timeframe", "claim_type")


def report_deltas(delta: DataFrame, categories: list[str], n: int = 10) -> DataFrame:
    f = delta.where(F.col("esg_category").isin(categories))
    d = F.col("delta_json_raw")
    order = [F.col("alignment_score_quick").asc_nulls_last(), F.col("esg_category").asc(),
             F.col("sub_theme").asc_nulls_last(), F.col("delta_json_raw").asc_nulls_last()]
    return top_n(f, order, n).select(
        "esg_category", "sub_theme", "alignment_score_quick",
        *[J.field(d, k).alias(k) for k in ["gap_headline", "official_narrative",
                                           "public_narrative", "risk_level"]])


def evidence_digest(insights: DataFrame, categories: list[str], per_category: int = 3,
                    summary_chars: int = 250, date_from=None, date_to=None) -> DataFrame:
    """One text row per category from its first non-empty credible summaries."""
    f = apply_filters(insights.where(F.col("esg_category").isin(categories)
                                     & (F.col("credibility_score") >= 6)
                                     & (F.col("impact_summary") != "")),
                      date_from=date_from, date_to=date_to)
    order = [F.col("scraped_date").desc(), F.col("article_id").asc(), F.col("url").asc()]
    first = cap_per_group(f.select("esg_category", "scraped_date", "article_id", "url",
                                   F.left("impact_summary", F.lit(summary_chars)).alias("s")),
                          ["esg_category"], order, per_category)
    return first.groupBy("esg_category").agg(
        ordered_join(F.col("s"), F.struct(newest_first("scraped_date"), F.col("article_id"),
                                          F.col("url")), "; ").alias("key_insights"))


# ---------------------------------------------------------------------------
# N-series: dashboard-side shaping, moved into the plan
# ---------------------------------------------------------------------------
def source_type_rollup(breakdown: DataFrame) -> DataFrame:
    """source_type totals over topics; article-weighted mean sentiment."""
    return breakdown.groupBy("source_type").agg(
        F.sum("article_count").alias("article_count"),
        F.sum("critical_count").alias("critical_count"),
        F.sum("supportive_count").alias("supportive_count"),
        F.count(F.lit(1)).alias("topic_count"),
        F.round(F.sum(F.col("avg_sentiment") * F.col("article_count"))
                / F.sum(F.when(F.col("avg_sentiment").isNotNull(), F.col("article_count"))), 3)
        .alias("avg_sentiment"))


def radar(breakdown: DataFrame) -> DataFrame:
    """Sentiment −1..1 scaled to 0..100 per category."""
    return breakdown.select(F.col("esg_category").alias("subject"),
                            F.round((F.col("avg_sentiment") + 1) * 50, 0).cast("int")
                            .alias("sentiment"), F.col("article_count").alias("articles"))


def severity_cards(by_severity: DataFrame) -> DataFrame:
    """The four severity cards, zero-filled (fixed 4-row dimension)."""
    spark = by_severity.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITY_ORDER, start=1)],
                                "severity STRING, rank INT")
    return (dim.join(by_severity, "severity", "left")
            .select("severity", "rank", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def perception_gap(kpi: DataFrame) -> DataFrame:
    """|public − official| × 100, one decimal; NULL if either side is NULL."""
    return kpi.select(F.round(F.abs(F.col("public_sentiment") - F.col("official_sentiment"))
                              * 100, 1).alias("perception_gap"))


def event_display(events: DataFrame) -> DataFrame:
    """Display defaults (severity → low, type → other, text "null" → NULL)."""
    return events.select("article_id", "url",
                         F.coalesce("severity", F.lit("low")).alias("severity"),
                         F.coalesce("event_type", F.lit("other")).alias("event_type"),
                         J.null_text_to_null("affected_product").alias("affected_product"),
                         J.null_text_to_null("financial_impact_estimate")
                         .alias("financial_impact_estimate"))


def lookback_from(as_of=None, days: int = 365) -> dt.date:
    """Default window start for overview/sources pages."""
    d = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of or dt.date.today()
    return d - dt.timedelta(days=days)
