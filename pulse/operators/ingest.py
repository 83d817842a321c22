"""Ingest shaping: record envelope, dedupe, run statistics, feed items.

Per-row steps are narrow; ``dedupe_first`` is a partial ``min_by`` aggregate
(a hot URL is reduced to one row per map task before the shuffle) and the
per-feed cap's ``row_number <= n`` is planned as a partial group limit before
the shuffle.  Dimension joins (feeds, URL metadata) leave the choice of a
broadcast to Spark's size check.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.ids import url_hash, uuid5_url
from pulse.functions.text import strip_py
from pulse.operators.filters import cap_per_group, first_per_key
from pulse.schemas import CRISIS_TOPICS, LANDING_FIELDS, MAX_BODY_CHARS, MIN_BODY_CHARS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# B1/B2/B3 envelope
# ---------------------------------------------------------------------------
def envelope(df: DataFrame) -> DataFrame:
    """Standard record envelope from (url, title, content, source_type, search_topic
    [, author, published_date, language]); ids derived from the URL."""
    cols = set(df.columns)
    opt = lambda n, d: (F.coalesce(F.col(n), F.lit(d)) if n in cols else F.lit(d))
    return df.select(
        uuid5_url("url").alias("article_id"), "url", url_hash("url").alias("url_hash"),
        "title", "content", "source_type", "search_topic",
        opt("author", "").alias("author"), opt("published_date", "").alias("published_date"),
        opt("language", "en").alias("language"),
        F.length("content").cast("string").alias("content_length"),
        *[c for c in df.columns if c not in {"url", "title", "content", "source_type",
                                               "search_topic", "author", "published_date",
                                               "language"}])


def stamp_run(df: DataFrame, run_id: str, run_ts: str) -> DataFrame:
    """Fill run id / scrape time where missing; stamp the run timestamp."""
    out = df
    for name, val in (("_scrape_run_id", run_id), ("_scraped_at", run_ts)):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(val)) if name in df.columns
                             else F.lit(val))
    return out.withColumn("_run_timestamp", F.lit(run_ts))


def to_landing(df: DataFrame) -> DataFrame:
    """Project onto the landing schema (extras dropped, missing fields NULL)."""
    return df.select(*[(F.col(f) if f in df.columns else F.lit(None)).cast("string").alias(f)
                       for f in LANDING_FIELDS])


# ---------------------------------------------------------------------------
# B4/B5/B6 union, dedupe, run statistics
# ---------------------------------------------------------------------------
def union_sources(*dfs: DataFrame, phase_col: str = "_phase") -> DataFrame:
    """Bag union in phase order; ``_phase`` records the source position for dedupe."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn(phase_col, F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: str = "url", order: Sequence[Column] | None = None) -> DataFrame:
    """First record per non-empty key; ``order`` (ascending columns) defines "first"
    (phase, then position)."""
    order = list(order) if order else [F.col("_phase")]
    return first_per_key(df.where(F.col(key).isNotNull() & (F.col(key) != "")), [key], order)


def run_stats(raw: DataFrame, deduped: DataFrame, run_ts: str, by: str = "source_type") -> DataFrame:
    """Per-source counts before dedupe plus a ``total`` row counted after dedupe."""
    ts = F.to_timestamp(F.lit(run_ts))
    per = raw.groupBy(F.col(by).alias("source_type")).agg(F.count(F.lit(1)).alias("count"))
    tot = deduped.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("source_type"),
                                                                "count")
    return per.unionByName(tot).withColumn("run_ts", ts)


def topic_family_counts(df: DataFrame, crisis_topics: Iterable[str] = CRISIS_TOPICS) -> DataFrame:
    """Records from strategy topics vs crisis topics (one global aggregate)."""
    is_crisis = F.col("search_topic").isin(list(crisis_topics))
    return df.agg(F.count_if(~is_crisis).alias("strategy_records"),
                  F.count_if(is_crisis).alias("crisis_records"))


# ---------------------------------------------------------------------------
# B8/B9/B10 feeds
# ---------------------------------------------------------------------------
def feed_dimension(spark: SparkSession, feeds: Sequence[tuple]) -> DataFrame:
    """(feed_name, filter_keywords[, source_type, topic]) rows from configuration."""
    rows = [(f[0], list(f[1]), *(f[2:4] if len(f) >= 4 else (None, None))) for f in feeds]
    return spark.createDataFrame(rows, "feed_name STRING, filter_keywords ARRAY<STRING>, "
                                       "source_type STRING, topic STRING")


def cap_per_feed(items: DataFrame, n: int = 20, order: Sequence[Column] | None = None,
                 feed: str = "feed_name") -> DataFrame:
    """The first n items of each feed (applied before the keyword filter)."""
    return cap_per_group(items, [feed], list(order or [F.col("item_no").asc()]), n)


def feed_filter(items: DataFrame, feeds: DataFrame, feed: str = "feed_name") -> DataFrame:
    """Keep items whose title + ' ' + summary contains any feed keyword
    (case-insensitive); feeds without keywords pass everything.  Spark broadcasts the
    feed dimension if it is small."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    one = feeds.dropDuplicates(["feed_name"])
    j = items.join(one.select(F.col("feed_name").alias(feed), "filter_keywords"), feed, "inner")
    kw = F.coalesce(F.col("filter_keywords"), F.array().cast("array<string>"))
    keep = (F.size(kw) == 0) | F.exists(kw, lambda k: F.contains(text, F.lower(k)))
    return j.where(keep).drop("filter_keywords")


RFC822_FMT = "dd MMM yyyy HH:mm:ss Z"


def feed_date(c) -> Column:
    """RFC-822 (weekday cut) else ISO, as TIMESTAMP; NULL if neither parses."""
    x = strip_py(c)
    no_wd = F.when(F.substring(x, 4, 1) == ",", F.substring(x, 6, 100)).otherwise(x)
    return F.coalesce(F.try_to_timestamp(no_wd, F.lit(RFC822_FMT)), F.try_to_timestamp(x))


def normalise_feed(items: DataFrame) -> DataFrame:
    """Link + (summary or description) required; tags stripped; the first of published,
    updated and created that parses, as ISO text (else blank)."""
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")),
                      F.nullif(F.col("description"), F.lit("")))
    body = strip_py(F.regexp_replace(body, r"<[^>]+>", " "))
    date_txt = F.date_format(F.coalesce(*[feed_date(c) for c in ("pubDate", "updated", "created")]),
                             "yyyy-MM-dd'T'HH:mm:ss")
    return (items.where(F.col("link").isNotNull() & (F.col("link") != ""))
            .select("*", body.alias("_body"), F.coalesce(date_txt, F.lit("")).alias("_date"))
            .where(F.col("_body").isNotNull() & (F.col("_body") != ""))
            .select(F.col("link").alias("url"), F.coalesce(F.col("title"), F.lit("")).alias("title"),
                    F.col("_body").alias("content"), F.coalesce("author", F.lit("")).alias("author"),
                    F.col("_date").alias("published_date"),
                    *[c for c in items.columns if c not in
                      {"link", "title", "summary", "description", "author", "pubDate", "updated",
                       "created"}]))


def attach_feed_meta(items: DataFrame, feeds: DataFrame, feed: str = "feed_name") -> DataFrame:
    """The feed's source type and topic on every item (``news`` / ``feed`` where the feed names none)."""
    m = feeds.dropDuplicates(["feed_name"]).select(F.col("feed_name").alias(feed), F.col("source_type").alias("_f_src"),
                                                   F.col("topic").alias("_f_topic"))
    return (items.join(m, feed, "left")
            .withColumn("source_type", F.coalesce("_f_src", F.lit("news")))
            .withColumn("search_topic", F.coalesce("_f_topic", F.lit("feed"))).drop("_f_src", "_f_topic"))


# ---------------------------------------------------------------------------
# B13/B14 URL metadata and body gate
# ---------------------------------------------------------------------------
def attach_url_meta(df: DataFrame, urls: DataFrame, default_source: str = "official",
                    default_topic: str = "direct_fetch") -> DataFrame:
    """Left lookup of (url → source_type, topic) with defaults; the first entry of a repeated URL holds."""
    m = urls.groupBy("url").agg(F.min_by(F.struct("source_type", "topic"), F.struct("source_type", "topic"))
                                .alias("m")).select("url", "m.*").select("url", F.col("source_type").alias("_m_src"), F.col("topic").alias("_m_topic"))
    return (df.join(m, "url", "left")
            .withColumn("source_type", F.coalesce("_m_src", F.lit(default_source)))
            .withColumn("search_topic", F.coalesce("_m_topic", F.lit(default_topic)))
            .drop("_m_src", "_m_topic"))


def gate_body(df: DataFrame, body: str = "content", min_chars: int = MIN_BODY_CHARS,
              max_chars: int = MAX_BODY_CHARS) -> DataFrame:
    """Body ≥ 80 chars, truncated to 20 000; title defaults to the URL."""
    return (df.where(F.length(F.col(body)) >= min_chars)
            .withColumn(body, F.left(F.col(body), F.lit(max_chars)))
            .withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))))
