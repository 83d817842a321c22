"""The daily ingest: responses, page contents and feeds to landing records and the run log.

``ingest_day`` is lazy; ``run_ingest`` parses the inputs once into a stored table, from which both the records and the
run's statistics are read, and writes both under the run's name: a retried run replaces its batch and its
log rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators import ingest as I
from pulse.operators.search_text import explode_search_results, explode_url_contents
from pulse.sources.store import stored
from pulse.sources.tables import append_run_log, write_landing

# The collectors that a run logs, each with or without records, in phase order.
SEARCH, FEEDS = "search", "rss"


def _placed(records: DataFrame, collector: str) -> DataFrame:
    """Records with their place in the collection: the input's file and row, then the block inside it."""
    has = set(records.columns)
    at = F.col("position") if "position" in has else F.struct(F.lit(None).cast("string").alias("file"),
                                                               F.lit(None).cast("long").alias("row"))
    row = F.coalesce(at["row"], F.col("item_no").cast("long")) if "item_no" in has else at["row"]
    block = F.col("block_no").cast("long") if "block_no" in has else F.lit(0).cast("long")
    placed = records.select("*", F.struct(at["file"].alias("file"), row.alias("row"), block.alias("block"),
                                          F.xxhash64(*[F.col(c) for c in records.columns]).alias("hash")).alias("_at"),
                            F.lit(collector).alias("_collector"))
    return placed.drop("position")


def collected_records(responses: DataFrame, contents: DataFrame, items: DataFrame, feeds: DataFrame,
                      urls: DataFrame) -> DataFrame:
    """The records of all three inputs in phase order (search, pages, feeds), in the landing envelope.

    ``_at`` orders a phase as it was collected: inputs that say their ``position`` (``tables.read_responses``) by file, row
    and block, feed items by ``item_no``, anything else by a hash of the record."""
    search = explode_search_results(responses)
    pages = I.attach_url_meta(I.gate_body(explode_url_contents(contents)), urls)
    kept = I.feed_filter(I.cap_per_feed(items), feeds)
    news = I.attach_feed_meta(I.normalise_feed(kept), feeds).withColumn("scraper", F.lit("feed"))
    return I.envelope(I.union_sources(_placed(search, SEARCH), _placed(pages, SEARCH), _placed(news, FEEDS)))


def first_order() -> list[Column]:
    """What "first" means for a URL that is found more than once: the phase, then the place in it."""
    return [F.col("_phase"), F.col("_at")]


def run_rows(raw: DataFrame, first: DataFrame, run_ts: str) -> DataFrame:
    """The run log rows: one per collector (zero included) counted before dedupe, and ``total`` after it."""
    none = raw.sparkSession.createDataFrame([(SEARCH, 0), (FEEDS, 0)], "source_type STRING, count LONG")
    found = raw.groupBy(F.col("_collector").alias("source_type")).agg(F.count(F.lit(1)).alias("count")).unionByName(none)
    total = first.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("source_type"), "count")
    return (found.groupBy("source_type").agg(F.sum("count").alias("count")).unionByName(total)
            .withColumn("run_ts", F.to_timestamp(F.lit(run_ts))))


def ingest_day(responses: DataFrame, contents: DataFrame, items: DataFrame, feeds: DataFrame, urls: DataFrame,
               run_id: str, run_ts: str) -> tuple[DataFrame, DataFrame]:
    """(landing records, run log rows): one record per URL, the first that was collected.

    The collected records are stored once; both results read that table."""
    raw = stored(collected_records(responses, contents, items, feeds, urls), "collected")
    first = I.dedupe_first(raw, order=first_order())
    return I.to_landing(I.stamp_run(first, run_id, run_ts)), run_rows(raw, first, run_ts)


def run_ingest(responses: DataFrame, contents: DataFrame, items: DataFrame, feeds: DataFrame, urls: DataFrame,
               landing: str, run_log: str, run_id: str, run_ts: str) -> None:
    """Write the day's records under ``landing`` and its rows of ``run_log``; a rerun replaces both."""
    records, stats = ingest_day(responses, contents, items, feeds, urls, run_id, run_ts)
    write_landing(records, landing, batch=run_id)
    append_run_log(stats, run_log, run=run_id)
