"""Landing → bronze → silver: typed projection, text cleaning, quality rules.

All steps are narrow (per-row) transformations: no shuffle, whole-stage
codegen, and they work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.dates import published_at
from pulse.functions.text import blank_to_null, clean_text, preview
from pulse.schemas import (ESG_HINT_DEFAULT, ESG_HINT_TOPICS, MIN_CLEAN_CHARS,
                           MIN_URL_CHARS, SOURCE_TYPES)


def _keep(keep: Iterable[str]) -> list[str]:
    return list(keep or ())


# ---------------------------------------------------------------------------
# C1/C2 bronze
# ---------------------------------------------------------------------------
def to_bronze(landing: DataFrame, keep: Iterable[str] = (),
              with_metadata: bool = False) -> DataFrame:
    """Typed bronze projection; rows without url or content are dropped.

    ``with_metadata`` adds the source file path and modification time (only for
    file sources, where Spark exposes the hidden ``_metadata`` column).
    """
    cols = [
        "article_id", "url", "url_hash", "title",
        F.col("content").alias("raw_content"),
        F.col("content_length").try_cast("int").alias("content_length"),
        "source_type", "search_topic", "author", "published_date", "language", "scraper",
        "_scrape_run_id",
        F.col("_scraped_at").try_cast("timestamp").alias("scraped_at"),
        F.col("_run_timestamp").try_cast("timestamp").alias("run_timestamp"),
        F.current_timestamp().alias("_ingested_at"),
    ]
    if with_metadata:
        cols += [F.col("_metadata.file_path").alias("_source_file"),
                 F.col("_metadata.file_modification_time").alias("_file_modified_at")]
    cols += _keep(keep)
    return (landing.where(F.col("url").isNotNull() & F.col("content").isNotNull())
            .select(*cols))


# ---------------------------------------------------------------------------
# C7 topic → ESG hint (a literal map lookup: no join, no shuffle)
# ---------------------------------------------------------------------------
def esg_hint(topic, mapping: Mapping[str, list[str]] = ESG_HINT_TOPICS,
             default: str = ESG_HINT_DEFAULT) -> Column:
    pairs = []
    for hint, topics in mapping.items():
        for t in topics:
            pairs += [F.lit(t), F.lit(hint)]
    m = F.create_map(*pairs)
    t = F.col(topic) if isinstance(topic, str) else topic
    return F.coalesce(F.try_element_at(m, t), F.lit(default))


# ---------------------------------------------------------------------------
# C10/C11 expectations
# ---------------------------------------------------------------------------
def drop_rules() -> dict[str, Column]:
    """Rows failing any of these are dropped (NULL counts as a failure).

    Each rule reads its column once and is never null: pushed below the cleaning, a null check that Catalyst
    infers beside it would run the whole regex chain a second time."""
    return {
        "valid_content": F.coalesce(F.length("clean_content"), F.lit(0)) >= MIN_CLEAN_CHARS,
        "valid_url": F.coalesce(F.length("url"), F.lit(0)) >= MIN_URL_CHARS,
    }


def warn_rules() -> dict[str, Column]:
    """Rows failing these are kept; violations are only counted."""
    return {"valid_source": F.col("source_type").isin(SOURCE_TYPES)}


def apply_expectations(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Drop rows that violate any rule (a filter drops NULL as well)."""
    for rule in (drop_rules() if rules is None else rules).values():
        df = df.where(rule)
    return df


def all_rules() -> dict[str, Column]:
    """The drop rules, whose violations go, and the warn rules, whose violations stay."""
    return {**drop_rules(), **warn_rules()}


def expectation_report(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: ``rows`` and ``<rule>_violations`` per rule (single aggregate job).

    Over ``silver_articles(…, expectations=False)`` with ``all_rules()`` it also counts the rows
    that the drop rules remove."""
    rules = warn_rules() if rules is None else rules
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"{n}_violations")
             for n, c in rules.items()]
    return df.agg(*aggs)


def observe_expectations(df: DataFrame, name: str = "silver_quality",
                         rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Streaming-friendly variant: metrics ride along the query via ``observe``."""
    rules = warn_rules() if rules is None else rules
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"{n}_violations")
                for n, c in rules.items()]
    return df.observe(name, *metrics)


# ---------------------------------------------------------------------------
# L3 silver
# ---------------------------------------------------------------------------
def silver_articles(bronze: DataFrame, keep: Iterable[str] = (),
                    expectations: bool = True, gate: bool = True) -> DataFrame:
    """Cleaned articles: C3–C8 projections, the raw-length gate (``gate``), drop expectations."""
    pub = published_at("published_date", "scraped_at")
    raw = bronze.where(F.col("raw_content").isNotNull()
                       & (F.length(F.trim("raw_content")) >= MIN_CLEAN_CHARS)) if gate else bronze
    out = (raw
           .select(
               "article_id", "url", "url_hash",
               clean_text("raw_content").alias("clean_content"),
               preview("raw_content").alias("content_preview"),
               F.col("content_length").cast("int").alias("content_length"),
               "title", "author",
               pub.alias("published_at"),
               F.to_date(pub).alias("scraped_date"),
               "source_type", "search_topic",
               esg_hint("search_topic").alias("esg_hint"),
               F.coalesce(blank_to_null(F.col("language")), F.lit("en")).alias("language"),
               "scraper", "_scrape_run_id", "scraped_at", "run_timestamp", "_ingested_at",
               F.current_timestamp().alias("_silver_at"),
               *_keep(keep)))
    return apply_expectations(out) if expectations else out


def scoring_candidates(silver: DataFrame) -> DataFrame:
    """Articles long enough to be worth a model call."""
    chars = F.coalesce(F.col("content_length"), F.length("clean_content"))
    return silver.where(F.when(F.col("clean_content").isNotNull(), chars).otherwise(0) >= MIN_CLEAN_CHARS)
