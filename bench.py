"""Benchmark: pipeline refresh + dashboard queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Per query: one warm-up, then the median of
$BENCH_REPEAT runs, each written with ``format("noop")`` (full execution,
no output cost).  The refresh step materialises the gold datasets to a
scratch folder (on a cluster: the shared table location); dashboard
queries then read those tables, as the reference's dashboards read its
materialised views.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import uuid
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulse.session import ensure_checkpoint_dir, local_session  # noqa: E402


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


ERRORS: dict[str, str] = {}


def _time(fn, repeat, name=None):
    """Median of ``repeat`` timed runs after one warm-up; None (and the error
    recorded) if the query fails, so one failure does not lose the report."""
    try:
        fn()  # warm-up
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t)
        return statistics.median(runs)
    except Exception as e:  # noqa: BLE001
        ERRORS[name or "?"] = str(e)[:300]
        return None


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2,
                          extra={"spark.pulse.scanPartitions": cpus})  # one-row-group test files

    from pulse.plans import blocks as B
    from pulse.plans import dashboard as M
    from pulse.plans import driver_tables as FP
    from pulse.sources.tables import materialize, read_table

    # Gold tables go under the shared folder the session names (spark.checkpoint.dir).
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    times: dict[str, float] = {}

    def refresh():
        # step by step from stored tables, as plans/refresh.py does
        from pulse.operators.enrich import ColumnResponder
        from pulse.operators.quarantine import judged_articles, kept, write_judged
        from pulse.plans import datasets as L
        from pulse.sources.fixtures import FIXTURE_KEEP
        materialize(FP.bronze(spark, sf_dir), f"{scratch}/bronze")
        write_judged(judged_articles(read_table(spark, f"{scratch}/bronze"), keep=FIXTURE_KEEP), f"{scratch}/judged")
        scored = L.scored_articles(kept(spark, f"{scratch}/judged"), ColumnResponder("sentiment_answer"),
                                   keep=["doc_id", "esg_answer", "claims_answer", "event_answer"])
        ins_path = f"{scratch}/insights"
        materialize(L.article_insights(scored, ColumnResponder("esg_answer"), keep=["doc_id", "claims_answer", "event_answer"]),
                    ins_path, sort_by=["scraped_date"])
        ins = read_table(spark, ins_path)
        cl = L.claims(ins, ColumnResponder("claims_answer"))
        materialize(cl, f"{scratch}/claims")
        wk = L.weekly_sentiment(ins)
        materialize(wk, f"{scratch}/weekly")
        materialize(L.impact_delta(read_table(spark, f"{scratch}/claims"),
                                   read_table(spark, f"{scratch}/weekly"), as_of=FP.AS_OF),
                    f"{scratch}/delta")
        materialize(L.news_events(ins, ColumnResponder("event_answer"), as_of=FP.AS_OF),
                    f"{scratch}/events")
        materialize(L.daily_summary(L.daily_stats(ins), headlines=L.headline_digest(ins)), f"{scratch}/summary")

    times["pipeline_refresh"] = _time(refresh, max(1, repeat - 1), "pipeline_refresh")

    if times["pipeline_refresh"] is not None:  # gold tables exist
        ins = read_table(spark, f"{scratch}/insights")
        cl = read_table(spark, f"{scratch}/claims")
        dl = read_table(spark, f"{scratch}/delta")
        ev = read_table(spark, f"{scratch}/events")
        sm = read_table(spark, f"{scratch}/summary")
        as_of = FP.AS_OF
        from pulse.operators.pages import RankIndex
        from pulse.plans.rollups import DailyRollup, refresh_daily
        M.write_explore_index(ins, f"{scratch}/ranks", 2 * int(cpus))
        refresh_daily(ins, f"{scratch}/days", "run-1")
        ranks, days = RankIndex(spark, f"{scratch}/ranks"), DailyRollup(spark, f"{scratch}/days")
        dash = {
            "g01_explore_offset_5000": lambda: M.explore_indexed(ranks, limit=50, offset=5000),
            "e02_kpis_from_days": lambda: days.kpis(),
            "m13_region_headlines": lambda: M.region_headlines(ev, 30, as_of),
            "m17_report_summaries": lambda: M.report_summaries(ins, ["Environmental", "Social", "Governance"]),
            "m01_explore": lambda: M.explore(ins, limit=50, offset=0, esg_category="Social"),
            "m01_explore_total": lambda: M.explore_total(ins, esg_category="Social"),
            "m02_category_breakdown": lambda: M.category_breakdown(ins),
            "m04_timeline_week": lambda: M.sentiment_timeline(ins, "week"),
            "m06_kpis": lambda: M.kpis(ins),
            "m07_source_breakdown": lambda: M.source_breakdown(ins),
            "m10_claims_list": lambda: M.claims_list(cl, limit=50),
            "m11_delta_summary": lambda: M.delta_summary(dl),
            "m12_events_page": lambda: M.events_page(ev, as_of=as_of),
            "m13_events_by_region": lambda: M.events_by_region(ev, 30, as_of),
            "m16_daily_brief": lambda: M.daily_brief(sm, date="2024-04-28"),
            "m17_report_stats": lambda: M.report_stats(ins, ["Environmental", "Social", "Governance"]),
        }
        for name, mk in dash.items():
            times[name] = _time(lambda mk=mk: _noop(mk()), repeat, name)

        from pulse.plans import datasets as L
        gold = {
            "l07_weekly_sentiment": lambda: L.weekly_sentiment(ins),
            "l10_impact_delta": lambda: L.impact_delta(cl, L.weekly_sentiment(ins), as_of=as_of),
            "l12_daily_stats": lambda: L.daily_stats(ins),
        }
        for name, mk in gold.items():
            times[name] = _time(lambda mk=mk: _noop(mk()), repeat, name)

    base = {
        "b11_search_results": lambda: B.search_results(spark, sf_dir),
        "c03_clean_pages": lambda: B.clean_pages(spark, sf_dir),
        "e06_median_by_group": lambda: B.events_median(spark, sf_dir),
        "k12_lexicon_sentiment": lambda: B.lexicon_sentiment(spark, sf_dir),
    }
    for name, mk in base.items():
        times[name] = _time(lambda mk=mk: _noop(mk()), repeat, name)

    total = sum(v for v in times.values() if v is not None)
    print(json.dumps({"metric": "total_query_seconds", "value": round(total, 3), "unit": "sec",
                      "queries": {k: (round(v, 3) if v is not None else None)
                                  for k, v in times.items()},
                      "errors": ERRORS,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus), "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
