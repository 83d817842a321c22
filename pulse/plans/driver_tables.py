"""The full pipeline wired over the driver tables (see ``pulse.sources.fixtures``).

Model steps use the fixture's answer columns (``ColumnResponder``) for the
per-article answers and the native rule stand-ins for the group-level
answers (delta, brief, headline).  The functions stay lazy: each
returns a DataFrame whose plan starts at the Parquet scans.  Only
``delta_inputs`` (and so ``delta``) reads the articles several times: like a
job it writes silver first, each time it is called, and builds the rest on
that table, so no text is cleaned twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from pulse.operators.clean import apply_expectations, silver_articles, to_bronze
from pulse.operators.enrich import ColumnResponder
from pulse.plans import datasets as L
from pulse.sources.fixtures import AS_OF, FIXTURE_KEEP, article_landing, run_log_frame
from pulse.sources.store import stored

ANSWERS = ["sentiment_answer", "esg_answer", "claims_answer", "event_answer"]


def _memo(fn):
    """Reuse the lazily built DataFrame per (session, folder).

    Building these plans costs thousands of Python→JVM calls; the plan object is
    immutable, so every query of a session can start from the same one.  No
    data is cached — each action still runs from the Parquet scans."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf: str) -> DataFrame:
        key = (id(spark), sf)
        hit = cache.get(key)
        if hit is None or hit[0] is not spark:
            hit = cache[key] = (spark, fn(spark, sf))
        return hit[1]
    return wrapper


@_memo
def landing(spark: SparkSession, sf: str) -> DataFrame:
    return article_landing(spark, sf)


@_memo
def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return to_bronze(landing(spark, sf), keep=FIXTURE_KEEP)


@_memo
def silver(spark: SparkSession, sf: str) -> DataFrame:
    return silver_articles(bronze(spark, sf), keep=FIXTURE_KEEP)


def scored_of(silver_df: DataFrame) -> DataFrame:
    return L.scored_articles(silver_df, ColumnResponder("sentiment_answer"),
                             keep=["doc_id", "esg_answer", "claims_answer", "event_answer"])


def insights_of(scored_df: DataFrame) -> DataFrame:
    return L.article_insights(scored_df, ColumnResponder("esg_answer"),
                              keep=["doc_id", "claims_answer", "event_answer"])


def claims_of(insights_df: DataFrame) -> DataFrame:
    return L.claims(insights_df, ColumnResponder("claims_answer"))


def events_of(insights_df: DataFrame) -> DataFrame:
    return L.news_events(insights_df, ColumnResponder("event_answer"), as_of=AS_OF)


@_memo
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_of(silver(spark, sf))


@_memo
def insights(spark: SparkSession, sf: str) -> DataFrame:
    return insights_of(scored(spark, sf))


@_memo
def claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims_of(insights(spark, sf))


def stored_silver(spark: SparkSession, sf: str) -> DataFrame:
    """Silver over a table of the cleaned texts written for this call: several tables built on it clean no text again.

    The rules that drop rows read that table: put before the write, they would clean every text a second time."""
    cleaned = silver_articles(bronze(spark, sf), keep=FIXTURE_KEEP, expectations=False)
    return apply_expectations(stored(cleaned.select(*L.SCORED_COLS, *FIXTURE_KEEP), "cleaned"))


@_memo
def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return L.weekly_sentiment(insights(spark, sf))


def delta_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(claims, weekly scores) that the comparison reads, over one stored silver."""
    ins = insights_of(scored_of(stored_silver(spark, sf)))
    return claims_of(ins), L.weekly_scores(ins)


def delta(spark: SparkSession, sf: str) -> DataFrame:
    return L.impact_delta(*delta_inputs(spark, sf), as_of=AS_OF)


@_memo
def events(spark: SparkSession, sf: str) -> DataFrame:
    return events_of(insights(spark, sf))


@_memo
def daily(spark: SparkSession, sf: str) -> DataFrame:
    return L.daily_stats(insights(spark, sf))


@_memo
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.daily_summary(daily(spark, sf), headlines=L.headline_digest(insights(spark, sf)))


@_memo
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return run_log_frame(spark, sf)
