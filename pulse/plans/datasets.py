"""Gold datasets (L-series): DataFrame in, DataFrame out.

Scale notes (what each plan shuffles):

* L4/L5/L11 are narrow (per row); model steps go through a ``Responder``.
* L6 filters before the model step and explodes answers locally (no shuffle).
* L7 is one hash aggregate (partial aggregation map-side; the exact median uses
  ``percentile``, whose buffer is a value→count map, so a hot group costs its
  distinct scores, not its rows) plus a top-5 per group whose ``row_number``
  filter Spark turns into a partial ``WindowGroupLimit`` before the shuffle.
  Both sides are one row per group when joined.
* L8/L9 aggregate small gold tables.  Lists are published whole, as child rows
  (``claim_items``, ``headline_items``); only a prompt joins the leading items
  that its fixed prefix can hold (a partial top-k before the shuffle).
* L10 joins two aggregated tables on (category, theme) and on the category.
* L12 is one hash aggregate (count-distincts via Catalyst's expand).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions import json as J
from pulse.functions import prompts as P
from pulse.functions.agg import AVG_DECIMAL, avg_round, median
from pulse.functions.dates import as_date_lit, since
from pulse.functions.ids import sha_key
from pulse.functions.labels import sentiment_bucket
from pulse.operators.clean import scoring_candidates
from pulse.operators.quantiles import grouped_median
from pulse.operators.enrich import Responder, RuleResponder, rule_brief, rule_delta, \
    rule_headline, rule_quick_alignment
from pulse.schemas import CRISIS_TOPICS, OFFICIAL_SOURCES, PUBLIC_SOURCES

# Unrounded averages are exact decimal averages kept to 12 decimals (deterministic
# whatever the partitioning).
EXACT_DIGITS = 12


def _keep(keep: Iterable[str]) -> list[str]:
    return list(keep or ())


def _sum_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) (NULL only for an empty input)."""
    return F.sum(F.when(cond, 1).otherwise(0))


def newest_first(c: str) -> Column:
    """Ascending sort key that orders dates newest first (for struct sort keys)."""
    return -F.unix_date(F.col(c))


def ordered_join(value: Column, order: Column, sep: str) -> Column:
    """Deterministic ``concat_ws(sep, collect_list(value))``: values ordered by ``order``.

    Collects the group, so it is only used on bounded groups: after a top-k, or
    over a fixed calendar window."""
    arr = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    return F.array_join(F.transform(arr, lambda x: x["v"]), sep)


# ---------------------------------------------------------------------------
# L4 scored articles
# ---------------------------------------------------------------------------
SCORED_COLS = ["article_id", "url", "url_hash", "title", "content_preview", "clean_content",
               "content_length", "source_type", "search_topic", "esg_hint", "language",
               "published_at", "scraped_date", "scraper", "_scrape_run_id", "scraped_at"]


def scored_articles(silver: DataFrame, responder: Responder, keep: Iterable[str] = (),
                    entity: str = P.ENTITY) -> DataFrame:
    cand = scoring_candidates(silver)
    scored = responder.answer(cand, P.sentiment_prompt(entity=entity), "sentiment_json_raw")
    return scored.select(*SCORED_COLS, "sentiment_json_raw", *_keep(keep))


# ---------------------------------------------------------------------------
# L5 article insights
# ---------------------------------------------------------------------------
def article_insights(scored: DataFrame, responder: Responder, keep: Iterable[str] = (),
                     entity: str = P.ENTITY) -> DataFrame:
    with_esg = responder.answer(scored, P.esg_prompt(entity=entity), "esg_json_raw")
    s = J.parse_sentiment("sentiment_json_raw")
    e = F.col("esg_json_raw")
    return with_esg.select(
        "article_id", "url", "title", "content_preview", "clean_content", "source_type",
        "search_topic", "esg_hint", "language", "published_at", "scraped_date", "scraper",
        "_scrape_run_id", "scraped_at",
        s["sentiment"].alias("sentiment_label"),
        s["score"].alias("sentiment_score"),
        s["confidence"].alias("sentiment_confidence"),
        s["key_topics"].alias("sentiment_topics"),
        s["stance"].alias("stance"),
        "sentiment_json_raw",
        J.parse_esg(e).alias("esg_struct"),
        "esg_json_raw",
        J.field(e, "esg_category").alias("esg_category"),
        J.field(e, "esg_sub_theme").alias("esg_sub_theme"),
        J.field(e, "confidence").try_cast("double").alias("esg_confidence"),
        J.field(e, "is_official_csr").try_cast("boolean").alias("is_official_csr"),
        J.field(e, "impact_summary").alias("impact_summary"),
        J.field(e, "credibility_score").try_cast("int").alias("credibility_score"),
        J.parse_ok("sentiment_json_raw").alias("sentiment_parse_ok"),
        J.parse_ok(e).alias("esg_parse_ok"),
        *_keep(keep))


# ---------------------------------------------------------------------------
# L6 claims
# ---------------------------------------------------------------------------
def claim_sources(insights: DataFrame, min_credibility: int = 6) -> DataFrame:
    """Official/benchmark articles credible enough for claim extraction (before the model)."""
    return insights.where(F.col("source_type").isin(OFFICIAL_SOURCES)
                          & (F.col("credibility_score") >= min_credibility)
                          & F.col("clean_content").isNotNull())


def claims(insights: DataFrame, responder: Responder, entity: str = P.ENTITY) -> DataFrame:
    src = responder.answer(claim_sources(insights), P.claims_prompt(entity=entity),
                           "claims_json_raw")
    ex = (src.select("article_id", "url", "title", "source_type", "search_topic",
                     "esg_category", "esg_sub_theme", "published_at", "scraped_date",
                     "credibility_score",
                     F.explode(J.parse_claims("claims_json_raw")).alias("c"))
          .where(F.col("c").isNotNull()))
    return ex.select(
        sha_key("article_id", F.col("c.claim_text")).alias("claim_id"),
        "article_id", "url", "title", "source_type", "search_topic",
        F.coalesce("c.esg_category", "esg_category").alias("esg_category"),
        F.coalesce("c.sub_theme", "esg_sub_theme").alias("sub_theme"),
        F.col("c.claim_text").alias("claim_text"),
        F.col("c.metric").alias("metric"),
        F.col("c.timeframe").alias("timeframe"),
        F.col("c.claim_type").alias("claim_type"),
        "published_at", "scraped_date", "credibility_score")


# ---------------------------------------------------------------------------
# L7 weekly public sentiment
# ---------------------------------------------------------------------------
WEEK_KEYS = ["esg_category", "esg_sub_theme", "week_start", "year", "month"]


def public_articles(insights: DataFrame) -> DataFrame:
    return (insights
            .where(F.col("source_type").isin(PUBLIC_SOURCES)
                   & F.col("esg_category").isNotNull()
                   & (F.col("esg_category") != "Not-ESG")
                   & F.col("sentiment_score").isNotNull())
            .select("url", "content_preview", "esg_category", "esg_sub_theme",
                    "sentiment_label", "sentiment_score", "stance", "credibility_score",
                    F.to_date(F.date_trunc("week", "scraped_date")).alias("week_start"),
                    F.year("scraped_date").alias("year"),
                    F.month("scraped_date").alias("month")))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Top-k rows per group; Spark plans a partial WindowGroupLimit before the shuffle,
    so each map task forwards at most k rows per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def weekly_sentiment(insights: DataFrame, evidence_k: int = 5,
                     median_accuracy: int | None = None, radix_median: bool = False) -> DataFrame:
    """``weekly_scores`` and the group's best articles as ``top_evidence``."""
    pub = public_articles(insights)
    top = top_k_per_group(pub, WEEK_KEYS,
                          [F.col("credibility_score").desc_nulls_last(), F.col("url").asc(),
                           F.col("content_preview").asc()], evidence_k)
    ev = top.groupBy(*WEEK_KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "_rn", F.col("content_preview").alias("snippet"), "url",
        F.col("credibility_score").alias("score")))).alias("_ev"))
    ev = ev.select(*WEEK_KEYS, F.transform("_ev", lambda x: F.struct(
        x["snippet"].alias("snippet"), x["url"].alias("url"), x["score"].alias("score")))
        .alias("top_evidence"))
    return _null_safe_join(weekly_scores(insights, median_accuracy, radix_median), ev, WEEK_KEYS)


def weekly_scores(insights: DataFrame, median_accuracy: int | None = None,
                  radix_median: bool = False) -> DataFrame:
    """L7 without the evidence: one aggregate over the public articles.

    The exact median is ``percentile`` by default (its buffer is bounded by
    the distinct scores of a group).  ``radix_median=True`` uses ``grouped_median``,
    which never holds a group's values, for models that emit unbounded score
    precision; ``median_accuracy`` uses a fixed-size sketch instead."""
    pub = public_articles(insights)
    use_radix = radix_median and median_accuracy is None
    med = [] if use_radix else [median("sentiment_score", median_accuracy).alias("median_score")]
    agg = pub.groupBy(*WEEK_KEYS).agg(
        F.count(F.lit(1)).alias("article_count"),
        F.avg(F.col("sentiment_score").try_cast(AVG_DECIMAL)).alias("avg_dec"),
        *med,
        _sum_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        _sum_if(F.col("sentiment_label") == "neutral").alias("neutral_count"),
        _sum_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        _sum_if(F.col("stance") == "critical").alias("critical_count"),
        _sum_if(F.col("stance") == "supportive").alias("supportive_count"))
    if use_radix:
        agg = _null_safe_join(agg, grouped_median(pub, WEEK_KEYS, "sentiment_score", "median_score"),
                              WEEK_KEYS)
    return agg.select(
        F.concat(F.col("esg_category"), F.lit("_"), F.date_format("week_start", "yyyy-MM-dd"))
        .alias("period_key"),
        *WEEK_KEYS, "article_count",
        F.round("avg_dec", 4).cast("double").alias("avg_sentiment_score"),
        F.round("median_score", 4).alias("median_sentiment_score"),
        "positive_count", "neutral_count", "negative_count", "critical_count",
        "supportive_count",
        F.round(F.lit(100.0) * F.col("critical_count") / F.col("article_count"), 1)
        .alias("pct_critical"),
        sentiment_bucket("avg_dec", 0.05).alias("overall_sentiment_label"))


# ---------------------------------------------------------------------------
# L8 claim rollup / L9 sentiment window / L10 impact delta
# ---------------------------------------------------------------------------
CLAIM_TEXT_CHARS = 200
THEME = ["esg_category", "sub_theme"]
_CLAIM_ORDER = ["scraped_date", "claim_id"]
# Each claim after the first adds ≥ 3 chars (" | "), so the first
# 1 + ceil(2000 / 3) = 668 claims always cover the 2000-char prompt prefix.
DIGEST_CLAIMS = 1 + -(-P.DELTA_CLAIMS // 3)


def claim_summary(claims_df: DataFrame) -> DataFrame:
    """Per category × theme: number of claims and latest date.  The claims themselves are
    the child rows of ``claim_items``."""
    c = claims_df.where(F.col("claim_text").isNotNull())
    return c.groupBy(*THEME).agg(F.count(F.lit(1)).alias("claim_count"),
                                 F.max("scraped_date").alias("latest_claim_date"))


def claim_items(claims_df: DataFrame) -> DataFrame:
    """Every claim of every category × theme, one row each (order: newest first, then claim id)."""
    return claims_df.where(F.col("claim_text").isNotNull()).select(
        *THEME, *_CLAIM_ORDER, F.left("claim_text", F.lit(CLAIM_TEXT_CHARS)).alias("claim_text"))


def claim_digest(claims_df: DataFrame) -> DataFrame:
    """The leading claims of a theme as one text, for prompts only: exact as far as a prompt
    reads it (its 2000-char prefix)."""
    lead = top_k_per_group(claim_items(claims_df), THEME,
                           [F.col("scraped_date").desc_nulls_last(),
                            F.col("claim_id").asc_nulls_last()], DIGEST_CLAIMS)
    return lead.groupBy(*THEME).agg(
        ordered_join(F.col("claim_text"), F.col("_rn"), " | ").alias("claims_combined"))


def sentiment_window(weekly: DataFrame, as_of=None, days: int = 90) -> DataFrame:
    """Per category × theme over the trailing window of weeks."""
    w = weekly.where(F.col("week_start") >= since(days, as_of))
    evidence = F.concat(F.lit("Week "), F.date_format("week_start", "yyyy-MM-dd"), F.lit(": "),
                        F.col("article_count").cast("string"), F.lit(" articles, score="),
                        F.round("avg_sentiment_score", 2).cast("string"))
    return w.groupBy("esg_category", "esg_sub_theme").agg(
        avg_round("avg_sentiment_score", EXACT_DIGITS).alias("period_avg_sentiment"),
        F.sum("article_count").alias("total_articles"),
        avg_round("pct_critical", EXACT_DIGITS).alias("avg_pct_critical"),
        F.max("overall_sentiment_label").alias("dominant_sentiment"),
        ordered_join(evidence, F.struct(F.col("week_start"), F.col("year"), F.col("month")),
                     " | ").alias("sentiment_evidence_summary"),
        F.max("week_start").alias("latest_week"))


def join_claims_sentiment(cs: DataFrame, sw: DataFrame) -> DataFrame:
    """Claims ⟕ sentiment on category and (theme equal or sentiment theme NULL).

    One left equi-join instead of a join with an OR: the sentiment rows that a claim's theme may meet are its own
    theme's and the category's theme-less one, so every claim is put twice, once for each, and looks up
    (category, theme).  Of the claims that neither copy matches, the first stays with empty sentiment columns."""
    facts = ["period_avg_sentiment", "total_articles", "avg_pct_critical", "dominant_sentiment",
             "sentiment_evidence_summary", "latest_week"]
    left = cs.where(F.col("claim_count") > 0).withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    # a claim without a theme meets no theme of its own: that copy has no category to meet
    left = left.withColumn("_key", F.when(F.col("_own"), F.col("sub_theme"))).withColumn(
        "_cat", F.when(F.col("_own") & F.col("sub_theme").isNull(), None).otherwise(F.col("esg_category")))
    right = sw.select(F.col("esg_category").alias("_s_cat"), F.col("esg_sub_theme").alias("_s_theme"), F.lit(True).alias("_hit"),
                      *facts)
    on = (F.col("_cat") == F.col("_s_cat")) & F.col("_key").eqNullSafe(F.col("_s_theme"))
    both = left.join(right, on, "left")
    any_hit = F.max("_hit").over(Window.partitionBy("esg_category", "sub_theme"))
    return (both.withColumn("_any", any_hit)
            .where(F.col("_hit") | (F.col("_any").isNull() & F.col("_own")))
            .drop("_own", "_key", "_cat", "_s_cat", "_s_theme", "_hit", "_any"))


def impact_delta(claims_df: DataFrame, weekly: DataFrame, as_of=None,
                 responder: Responder | None = None,
                 quick_responder: Responder | None = None,
                 entity: str = P.ENTITY) -> DataFrame:
    stats = _null_safe_join(claim_summary(claims_df), claim_digest(claims_df), THEME)
    j = join_claims_sentiment(stats, sentiment_window(weekly, as_of))
    responder = responder or RuleResponder(rule_delta())
    quick_responder = quick_responder or RuleResponder(rule_quick_alignment())
    j = responder.answer(j, P.delta_prompt(entity=entity), "delta_json_raw")
    j = quick_responder.answer(j, P.quick_alignment_prompt(entity=entity), "_quick_json")
    as_of_c = as_date_lit(as_of)
    return j.select(
        sha_key("esg_category", F.coalesce("sub_theme", F.lit("")),
                F.date_format(as_of_c, "yyyy-MM-dd")).alias("delta_id"),
        "esg_category", "sub_theme", "claim_count", "total_articles", "period_avg_sentiment",
        "avg_pct_critical", "dominant_sentiment", "latest_claim_date", "latest_week",
        as_of_c.alias("analysis_date"), "delta_json_raw",
        J.field("_quick_json", "alignment_score").try_cast("int").alias("alignment_score_quick"))


# ---------------------------------------------------------------------------
# L11 crisis events
# ---------------------------------------------------------------------------
def news_events(insights: DataFrame, responder: Responder, as_of=None,
                days: int = 90, topics: list[str] = CRISIS_TOPICS,
                entity: str = P.ENTITY) -> DataFrame:
    src = insights.where(F.col("search_topic").isin(topics)
                         & (F.col("scraped_date") >= since(days, as_of))
                         & F.col("clean_content").isNotNull())
    ev = responder.answer(src, P.event_prompt(entity=entity), "event_json_raw")
    e = F.col("event_json_raw")
    return ev.select(
        "article_id", "url", "title", "content_preview", "clean_content", "source_type",
        "search_topic", "published_at", "scraped_date", "sentiment_label", "sentiment_score",
        "stance", "esg_category", "esg_sub_theme", "impact_summary", "credibility_score",
        "event_json_raw",
        *[J.field(e, f).alias(f) for f in ["event_type", "severity", "affected_region",
                                           "affected_product", "financial_impact_estimate",
                                           "recommended_response"]])


# ---------------------------------------------------------------------------
# L12 daily statistics / L13 daily summary
# ---------------------------------------------------------------------------
# Each headline after the first adds at least 7 chars ("[] " + " || "), so the
# first 1 + ceil(1500 / 7) headlines always fill the brief's 1500-char prompt window.
DIGEST_HEADLINES = 1 + -(-P.BRIEF_HEADLINES // 7)


def headline_items(insights: DataFrame) -> DataFrame:
    """Every credible headline (credibility ≥ 7) of every day, one row each."""
    return insights.select(
        F.col("scraped_date").alias("report_date"), "credibility_score", "url", "article_id",
        F.when(F.col("credibility_score") >= 7,
               F.concat(F.lit("["), F.col("source_type"), F.lit("] "),
                        F.left("title", F.lit(80)))).alias("headline")).where(F.col("headline").isNotNull())


def headline_digest(insights: DataFrame) -> DataFrame:
    """The day's leading headlines as one text, for the brief's prompt only: exact as far as the
    prompt reads it (its 1500-char prefix)."""
    lead = top_k_per_group(headline_items(insights), ["report_date"],
                           [F.col("credibility_score").desc(), F.col("url").asc(),
                            F.col("article_id").asc()], DIGEST_HEADLINES)
    return lead.groupBy("report_date").agg(
        ordered_join(F.col("headline"), F.col("_rn"), " || ").alias("top_headlines"))


def daily_stats(insights: DataFrame, as_of=None) -> DataFrame:
    """Per day; ``as_of`` narrows to one day (the reference keeps only today)."""
    src = insights if as_of is None else insights.where(
        F.col("scraped_date") == as_date_lit(as_of))
    return src.groupBy(F.col("scraped_date").alias("report_date")).agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_distinct("url").alias("unique_sources"),
        F.count_distinct("source_type").alias("source_types"),
        avg_round("sentiment_score", 4).alias("avg_sentiment"),
        _sum_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        _sum_if(F.col("sentiment_label") == "neutral").alias("neutral_count"),
        _sum_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        _sum_if(F.col("stance") == "critical").alias("critical_count"),
        _sum_if(F.col("esg_category") == "Environmental").alias("env_count"),
        _sum_if(F.col("esg_category") == "Social").alias("social_count"),
        _sum_if(F.col("esg_category") == "Governance").alias("gov_count"))


def daily_topics(insights: DataFrame) -> DataFrame:
    """E14, scalable form of the flattened topic bag: (day, topic, mentions)."""
    return (insights.select(F.col("scraped_date").alias("report_date"),
                            F.explode("sentiment_topics").alias("topic"))
            .groupBy("report_date", "topic").agg(F.count(F.lit(1)).alias("mentions")))


def daily_summary(stats: DataFrame, responder: Responder | None = None,
                  headline_responder: Responder | None = None, entity: str = P.ENTITY,
                  headlines: DataFrame | None = None) -> DataFrame:
    """The day's brief and headline.  ``headlines`` (``headline_digest``) feeds the brief's prompt."""
    responder = responder or RuleResponder(rule_brief())
    headline_responder = headline_responder or RuleResponder(rule_headline())
    s = (stats.join(headlines, "report_date", "left") if headlines is not None
         else stats.withColumn("top_headlines", F.lit(None).cast("string")))
    s = responder.answer(s, P.brief_prompt(entity=entity), "brief_json_raw")
    s = headline_responder.answer(s, P.headline_prompt(entity=entity), "_headline_json")
    return s.select(*stats.columns, "brief_json_raw",
                    J.field("_headline_json", "headline").alias("headline"))
