"""Schemas, answer DDLs and small fixed dimensions.

Fixed values below must equal the reference pipeline's for identical results
(source-type domain, topic → ESG-hint map, crisis topics, severity order).
They are stated plainly and kept together on purpose.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Landing record (JSON lines written by the scrapers; every field a string)
# ---------------------------------------------------------------------------
ARTICLE_LANDING = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("url_hash", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_length", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("search_topic", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_date", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("scraper", T.StringType()),
    T.StructField("_scrape_run_id", T.StringType()),
    T.StructField("_scraped_at", T.StringType()),
    T.StructField("_run_timestamp", T.StringType()),
])

LANDING_FIELDS = [f.name for f in ARTICLE_LANDING.fields]

RUN_LOG = T.StructType([
    T.StructField("source_type", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("run_ts", T.TimestampType()),
])

# Raw search-response table (one row per landed response text).
RESPONSE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("text", T.StringType()),
])

# Feed item as read from landed feed XML (<item> rows).
FEED_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("created", T.StringType()),
])

# ---------------------------------------------------------------------------
# Model answer schemas (JSON text → typed columns)
# ---------------------------------------------------------------------------
SENTIMENT_DDL = ("sentiment STRING, score DOUBLE, confidence DOUBLE, "
                 "key_topics ARRAY<STRING>, stance STRING")
ESG_DDL = ("esg_category STRING, esg_sub_theme STRING, confidence DOUBLE, "
           "key_claims ARRAY<STRING>, is_official_csr BOOLEAN, "
           "impact_summary STRING, credibility_score INT")
CLAIMS_DDL = ("ARRAY<STRUCT<claim_text: STRING, esg_category: STRING, sub_theme: STRING, "
              "metric: STRING, timeframe: STRING, claim_type: STRING>>")
EVENT_FIELDS = ["event_type", "severity", "affected_region", "affected_product",
                "financial_impact_estimate", "recommended_response"]
DELTA_FIELDS = ["alignment_label", "gap_headline", "official_narrative",
                "public_narrative", "marketing_opportunity", "risk_level"]
BRIEF_DDL = ("headline STRING, executive_brief STRING, top_risk STRING, "
             "top_opportunity STRING, esg_pulse STRUCT<environmental: INT, "
             "social: INT, governance: INT>, recommended_actions ARRAY<STRING>")

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's)
# ---------------------------------------------------------------------------
# Legal source types (warn-only expectation).
SOURCE_TYPES = ["official", "news", "social", "ngo", "benchmark", "rss"]
# Source families used by the sentiment splits.
PUBLIC_SOURCES = ["news", "ngo", "social", "benchmark"]        # weekly public sentiment
OFFICIAL_SOURCES = ["official", "benchmark"]                   # official split / claims
PUBLIC_SPLIT_SOURCES = ["news", "ngo", "social"]               # public split in timelines/KPIs
# Search topics that make an article a crisis/news event.
CRISIS_TOPICS = ["product_recall", "regulatory_action", "crisis_apac",
                 "crisis_media", "market_impact"]
# Search topic → ESG hint; anything else is 'Unknown'.
ESG_HINT_TOPICS = {
    "Environmental": ["environmental", "environmental_commitments", "greenwashing",
                      "water_rights"],
    "Social": ["social_mission", "worker_sentiment", "worker_conditions",
               "community_impact", "supply_chain", "human_rights", "restructuring",
               "nutrition_index"],
    "Governance": ["governance", "bcorp_certification", "bcorp_profile", "bcorp_news",
                   "impact_investment", "strategy"],
    "Cross-ESG": ["wba_index", "wba_food_agriculture", "wba_just_transition",
                  "wba_benchmark", "general_news", "esg_news", "esg_investor",
                  "food_industry", "annual_report"],
    "Crisis": ["product_recall", "crisis_apac", "regulatory_action", "crisis_media",
               "market_impact"],
}
ESG_HINT_DEFAULT = "Unknown"
# Severity display order (rank 1 first; anything else ranks 5).
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
# Risk order used for a ranked maximum.
RISK_ORDER = ["Low", "Medium", "High", "Critical"]
# Quality gates.
MIN_CLEAN_CHARS = 150
MIN_URL_CHARS = 11            # url length must be > 10
MIN_BODY_CHARS = 80
MAX_BODY_CHARS = 20000
PREVIEW_CHARS = 500
