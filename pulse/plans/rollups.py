"""Materialised aggregates refreshed by what changed.

Gold tables that are recomputed whole read every article for each refresh.  Here every run stores what it adds as partial aggregates, and
only the weeks or days that it touches are merged and rewritten (dynamic partition overwrite):

* weekly sentiment: counts per (group, score, label, stance), from which counts, exact averages and the exact median
  (``percentile`` with frequencies) all follow, and the run's five best evidence rows per group;
* daily statistics: counts and exact decimal sums per day, and the day's distinct URLs, source types and
  categories as bitmaps over dictionary codes.  Bitmaps are or'ed over any days and runs, so distinct counts of any range are
  exact without reading articles and without one copy of every row per distinct column.

Partials live in ``…/day=D/run=R`` (or ``week_start=W/run=R``).  A rerun of a run overwrites its own, so nothing is counted
twice; codes are only ever added.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions.agg import AVG_DECIMAL, sum_if
from pulse.functions.dates import as_date_lit
from pulse.functions.labels import sentiment_bucket
from pulse.plans.datasets import WEEK_KEYS, _null_safe_join, public_articles, top_k_per_group
from pulse.schemas import OFFICIAL_SOURCES, PUBLIC_SPLIT_SOURCES

EVIDENCE = 5


def _overwrite(df: DataFrame, path: str, *parts: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    (df.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
     .parquet(path))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _with_run(df: DataFrame, run: str) -> DataFrame:
    return df.withColumn("run", F.lit(run))


def _among(column: str, values: Iterable) -> Column:
    """Membership in a short list of dates that may hold null."""
    known = [v for v in values if v is not None]
    hit = F.col(column).isin(known) if known else F.lit(False)
    return hit | F.col(column).isNull() if len(known) < len(list(values)) else hit


# ---------------------------------------------------------------------------
# weekly sentiment
# ---------------------------------------------------------------------------
_SCORES = ("esg_category STRING, esg_sub_theme STRING, year INT, month INT, sentiment_score DOUBLE, sentiment_label STRING, "
           "stance STRING, n LONG, week_start DATE, run STRING")
_BEST = ("url STRING, content_preview STRING, esg_category STRING, esg_sub_theme STRING, credibility_score INT, year INT, "
         "month INT, week_start DATE, run STRING")


def _best(rows: DataFrame) -> DataFrame:
    return top_k_per_group(rows, WEEK_KEYS, [F.col("credibility_score").desc_nulls_last(), F.col("url").asc(),
                                             F.col("content_preview").asc()], EVIDENCE)


def weekly_rows(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """``datasets.weekly_sentiment`` from partial aggregates."""
    n, score = F.col("n"), F.col("sentiment_score").try_cast(AVG_DECIMAL)
    share = lambda c: F.sum(F.when(c, n).otherwise(0))
    weighted = F.sum(score * n.cast("decimal(12,0)"))
    agg = scores.groupBy(*WEEK_KEYS).agg(
        F.sum("n").alias("article_count"),
        (weighted / F.sum(F.when(score.isNotNull(), n)).cast("decimal(12,0)")).alias("avg_dec"),
        F.percentile("sentiment_score", 0.5, n).alias("median_score"),
        *[share(F.col("sentiment_label") == s).alias(f"{s}_count") for s in ("positive", "neutral", "negative")],
        *[share(F.col("stance") == s).alias(f"{s}_count") for s in ("critical", "supportive")])
    ev = _best(evidence).groupBy(*WEEK_KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "_rn", F.col("content_preview").alias("snippet"), "url", F.col("credibility_score").alias("score")))).alias("_ev"))
    ev = ev.select(*WEEK_KEYS, F.transform("_ev", lambda x: F.struct(x["snippet"].alias("snippet"), x["url"].alias("url"),
                                                                   x["score"].alias("score"))).alias("top_evidence"))
    return _null_safe_join(agg, ev, WEEK_KEYS).select(
        F.concat(F.col("esg_category"), F.lit("_"), F.date_format("week_start", "yyyy-MM-dd")).alias("period_key"),
        *WEEK_KEYS, "article_count", F.round("avg_dec", 4).cast("double").alias("avg_sentiment_score"),
        F.round("median_score", 4).alias("median_sentiment_score"),
        *[f"{s}_count" for s in ("positive", "neutral", "negative", "critical", "supportive")],
        F.round(F.lit(100.0) * F.col("critical_count") / F.col("article_count"), 1).alias("pct_critical"),
        sentiment_bucket("avg_dec", 0.05).alias("overall_sentiment_label"), "top_evidence")


def refresh_weekly(insights: DataFrame, root: str, run: str) -> list:
    """Add a run's articles to ``root``/weekly_sentiment; the weeks that were rewritten (one date each)."""
    spark = insights.sparkSession
    public = public_articles(insights)
    _overwrite(_with_run(public.groupBy(*WEEK_KEYS, "sentiment_score", "sentiment_label", "stance")
                         .agg(F.count(F.lit(1)).alias("n")), run), f"{root}/weekly_scores", "week_start", "run")
    _overwrite(_with_run(_best(public).drop("_rn", "sentiment_label", "sentiment_score", "stance"), run),
               f"{root}/weekly_evidence", "week_start", "run")
    scores, best = _read(spark, f"{root}/weekly_scores", _SCORES), _read(spark, f"{root}/weekly_evidence", _BEST)
    touched = [r[0] for r in scores.where(F.col("run") == run).select("week_start").distinct().collect()]
    hit = _among("week_start", touched)
    _overwrite(weekly_rows(scores.where(hit), best.where(hit)), f"{root}/weekly_sentiment", "week_start")
    return sorted(touched, key=str)


# ---------------------------------------------------------------------------
# daily statistics and KPIs
# ---------------------------------------------------------------------------
DISTINCT = ("url", "source_type", "esg_category")
_CODES = "value STRING, code LONG, name STRING"
_SETS = "name STRING, bucket LONG, bits BINARY, day DATE, run STRING"
_SUMS = ("n", "score_n", "official_n", "public_n", "positive", "neutral", "negative", "critical", "env", "social", "gov")
_TOTALS = ("score_sum", "official_sum", "public_sum")
_FACTS = (", ".join(f"{c} LONG" for c in _SUMS) + ", " + ", ".join(f"{c} DECIMAL(38,8)" for c in _TOTALS)
          + ", day DATE, run STRING")


def _add_codes(values: DataFrame, root: str, name: str) -> DataFrame:
    """(value, code) of every value of one column, new values numbered behind the known ones.

    New values are range-partitioned and numbered inside their partition; one count a partition meets in one task."""
    spark, path = values.sparkSession, f"{root}/codes"
    known = _read(spark, path, _CODES).where(F.col("name") == name)
    base = known.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]
    fresh = (values.where("value is not null").distinct().join(known.select("value"), "value", "left_anti")
             .repartitionByRange("value").withColumn("_part", F.spark_partition_id())
             .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    staged = f"{root}/_new_codes/name={name}"
    fresh.write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema("value STRING, _part INT, _pos LONG").parquet(staged)
    per = fresh.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    (fresh.join(before, "_part").select("value", (F.lit(base) + 1 + F.col("_off") + F.col("_pos")).alias("code"))
     .write.mode("append").parquet(f"{path}/name={name}"))
    return _read(spark, path, _CODES).where(F.col("name") == name).select("value", "code")


def refresh_daily(insights: DataFrame, root: str, run: str) -> list:
    """Add a run's articles to the daily partials under ``root``; the days that it touches."""
    spark = insights.sparkSession
    day, score = F.col("scraped_date").alias("day"), F.col("sentiment_score").try_cast(AVG_DECIMAL)
    official, public = F.col("source_type").isin(OFFICIAL_SOURCES), F.col("source_type").isin(PUBLIC_SPLIT_SOURCES)
    total = lambda c: F.sum(F.when(c, score)).cast("decimal(38,8)")
    facts = insights.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("score_n"), F.count(F.when(official, score)).alias("official_n"),
        F.count(F.when(public, score)).alias("public_n"),
        *[sum_if(F.col("sentiment_label") == s).alias(s) for s in ("positive", "neutral", "negative")],
        sum_if(F.col("stance") == "critical").alias("critical"),
        *[sum_if(F.col("esg_category") == c).alias(a) for a, c in (("env", "Environmental"), ("social", "Social"),
                                                                 ("gov", "Governance"))],
        total(F.lit(True)).alias("score_sum"), total(official).alias("official_sum"), total(public).alias("public_sum"))
    _overwrite(_with_run(facts, run), f"{root}/daily_facts", "day", "run")
    sets = None
    for name in DISTINCT:
        seen = insights.select(day, F.col(name).alias("value")).where("value is not null").distinct()
        codes = _add_codes(seen.select("value"), root, name)
        own = (seen.join(codes, "value").groupBy("day", F.bitmap_bucket_number("code").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
               .select(F.lit(name).alias("name"), "bucket", "bits", "day"))
        sets = own if sets is None else sets.unionByName(own)
    _overwrite(_with_run(sets, run), f"{root}/daily_sets", "day", "run")
    facts = _read(spark, f"{root}/daily_facts", _FACTS)
    return sorted((r[0] for r in facts.where(F.col("run") == run).select("day").distinct().collect()), key=str)


def _counted(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct counts per key from bitmaps: one column of the same name per counted column."""
    ored = sets.groupBy(*keys, "name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return ored.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == c, F.bitmap_count("bits")).otherwise(0)).alias(c)
                                     for c in DISTINCT])


def _added(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS],
                                    *[F.sum(c).alias(c) for c in _TOTALS], F.max("day").alias("last_day"))


def _mean(total: str, n: str, digits: int) -> Column:
    return F.round(F.col(total) / F.nullif(F.col(n), F.lit(0)).cast("decimal(12,0)"), digits).cast("double")


class DailyRollup:
    """The merged daily partials under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.facts, self.sets = _read(spark, f"{root}/daily_facts", _FACTS), _read(spark, f"{root}/daily_sets", _SETS)

    def stats(self) -> DataFrame:
        """``datasets.daily_stats`` of every day, from day rows."""
        counted = _counted(self.sets, ["day"]).withColumnRenamed("day", "_day")
        both = _added(self.facts, ["day"]).join(counted, F.col("day").eqNullSafe(F.col("_day")), "left")
        known = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return both.select(
            F.col("day").alias("report_date"), F.col("n").alias("total_articles"), known(F.col("url")).alias("unique_sources"),
            known(F.col("source_type")).alias("source_types"), _mean("score_sum", "score_n", 4).alias("avg_sentiment"),
            *[F.col(c).alias(f"{c}_count") for c in ("positive", "neutral", "negative", "critical", "env", "social", "gov")])

    def kpis(self, date_from=None, date_to=None) -> DataFrame:
        """``dashboard.kpis`` of any range of days: always one row, read from day rows only."""
        def within(df):
            df = df if date_from is None else df.where(F.col("day") >= as_date_lit(date_from))
            return df if date_to is None else df.where(F.col("day") <= as_date_lit(date_to))
        # one row each
        return _added(within(self.facts), []).join(_counted(within(self.sets), []), F.lit(True)).select(
            F.col("n").alias("total_articles"), F.coalesce("url", F.lit(0)).alias("unique_urls"),
            F.coalesce("source_type", F.lit(0)).alias("source_types"), _mean("score_sum", "score_n", 3).alias("overall_sentiment"),
            _mean("official_sum", "official_n", 3).alias("official_sentiment"),
            _mean("public_sum", "public_n", 3).alias("public_sentiment"), F.when(F.col("n") > 0, F.col("critical")).alias("critical_articles"),
            F.coalesce("esg_category", F.lit(0)).alias("esg_categories_covered"),
            F.col("last_day").alias("latest_scrape_date"))
