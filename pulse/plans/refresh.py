"""The full refresh as a Spark job: landing files → bronze → silver → gold tables.

Each dataset is written before the next reads it (as materialised views are),
so every step starts from stored columns, a retried step recomputes only
itself, and lineage never grows across steps.  Bronze and silver can run
incrementally (triggered streams with checkpoints) or as batch rewrites.

    python -m pulse.plans.refresh --landing s3://…/landing --root s3://…/tables \
        [--as-of 2024-04-30] [--incremental]

The command line uses the offline rule stand-ins for every model step; from
Python, pass ``Responders`` with a ``ModelResponder`` (and its answer cache)
per step.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt

from pyspark.sql import SparkSession

from pulse.operators.clean import to_bronze
from pulse.operators.enrich import (Responder, RuleResponder, rule_brief, rule_claims, rule_delta,
                                    rule_esg, rule_event, rule_headline, rule_quick_alignment,
                                    rule_sentiment)
from pulse.operators.quarantine import judged_articles, kept_path, write_judged
from pulse.plans import datasets as L
from pulse.sources.tables import materialize, read_landing, read_table
from pulse.streaming.incremental import run_bronze_stream, run_silver_stream


@dataclasses.dataclass
class Responders:
    """One responder per model step (defaults: offline rule stand-ins)."""
    sentiment: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_sentiment()))
    esg: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_esg()))
    claims: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_claims()))
    events: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_event()))
    delta: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_delta()))
    quick: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_quick_alignment()))
    brief: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_brief()))
    headline: Responder = dataclasses.field(default_factory=lambda: RuleResponder(rule_headline()))


TABLES = ["bronze_articles", "silver_articles", "scored_articles", "article_insights", "claims",
          "weekly_sentiment", "impact_delta", "news_events", "daily_summary"]


def refresh(spark: SparkSession, landing: str, root: str, as_of=None,
            responders: Responders | None = None, incremental: bool = False,
            timeout_s: float | None = 3600) -> dict[str, str]:
    """Rebuild every dataset under ``root``; returns {table name: path}."""
    r = responders or Responders()
    as_of = as_of or dt.date.today()
    p = {t: f"{root.rstrip('/')}/{t}" for t in TABLES}

    if incremental:
        run_bronze_stream(spark, landing, p["bronze_articles"], f"{root}/_checkpoints/bronze", timeout_s)
        run_silver_stream(spark, p["bronze_articles"], p["silver_articles"],
                          f"{root}/_checkpoints/silver", timeout_s)
    else:
        materialize(to_bronze(read_landing(spark, landing), with_metadata=True),
                    p["bronze_articles"], partition_by=["source_type"], sort_by=["search_topic"])
        # one pass cleans and judges; silver is the folder of the kept rows, refused ones stand beside it
        judged = f"{root.rstrip('/')}/judged_articles"
        write_judged(judged_articles(read_table(spark, p["bronze_articles"])), judged,
                     partition_by=["source_type"], sort_by=["search_topic", "scraped_date"])
        p["silver_articles"] = kept_path(judged)

    materialize(L.scored_articles(read_table(spark, p["silver_articles"]), r.sentiment),
                p["scored_articles"])
    materialize(L.article_insights(read_table(spark, p["scored_articles"]), r.esg),
                p["article_insights"], sort_by=["scraped_date"])
    ins = read_table(spark, p["article_insights"])
    materialize(L.claims(ins, r.claims), p["claims"])
    materialize(L.weekly_sentiment(ins), p["weekly_sentiment"])
    materialize(L.impact_delta(read_table(spark, p["claims"]), read_table(spark, p["weekly_sentiment"]),
                               as_of=as_of, responder=r.delta, quick_responder=r.quick),
                p["impact_delta"])
    materialize(L.news_events(ins, r.events, as_of=as_of), p["news_events"])
    materialize(L.daily_summary(L.daily_stats(ins), r.brief, r.headline, headlines=L.headline_digest(ins)),
                p["daily_summary"])
    return p


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Refresh the pulse datasets")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--root", required=True)
    ap.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    ap.add_argument("--incremental", action="store_true")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("pulse-refresh").getOrCreate()
    for name, path in refresh(spark, a.landing, a.root, a.as_of, incremental=a.incremental).items():
        print(name, path)


if __name__ == "__main__":
    main()
