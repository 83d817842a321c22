"""B8/D4 for large keyword dimensions: an inverted index of keyword grams instead of a loop per row.

``ingest.feed_filter`` tests every keyword of a feed against every item, which is right for a few dozen.  Here every
keyword is filed under one gram of up to ``GRAM`` characters, the one that fewest keywords of all share.  An item's distinct grams are joined to the
index by (feed, gram); only keywords whose gram stands in the item are then tested as substrings.  The work per item
follows its length and its few candidates, not the number of keywords.

Only keys and grams are exploded and shuffled, never texts; a verified key keeps its item by a semi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.text import grams as grams_of

GRAM = 5


def keyword_index(feeds: DataFrame, feed: str = "feed_name") -> DataFrame:
    """(feed, keyword, gram) of every distinct non-empty keyword, lower-cased; the first entry of a repeated feed holds."""
    words = (feeds.dropDuplicates(["feed_name"])
             .select(F.col("feed_name").alias(feed), F.explode(F.transform("filter_keywords", F.lower)).alias("keyword"))
             .where(F.length("keyword") > 0).distinct())
    # a shorter keyword is its own gram
    grams = words.withColumn("gram", F.explode(F.when(F.length("keyword") < GRAM, F.array("keyword"))
                                               .otherwise(grams_of("keyword", GRAM))))
    shared = grams.groupBy(F.col("gram").alias("_gram")).agg(F.count(F.lit(1)).alias("_n"))
    return (grams.join(shared, F.col("gram") == F.col("_gram")).groupBy(feed, "keyword")
            .agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram")))


def open_feeds(feeds: DataFrame, feed: str = "feed_name") -> DataFrame:
    """The feeds that let every item pass: without keywords, or with an empty one."""
    kw = F.coalesce(F.col("filter_keywords"), F.array().cast("array<string>"))
    return (feeds.dropDuplicates(["feed_name"]).where((F.size(kw) == 0) | F.exists(kw, lambda k: F.length(k) == 0))
            .select(F.col("feed_name").alias(feed)))


def feed_filter_indexed(items: DataFrame, index: DataFrame, open_to_all: DataFrame, key: Sequence[str] = ("feed_name", "item_no"),
                        feed: str = "feed_name") -> DataFrame:
    """``ingest.feed_filter`` through an index: ``key`` names the columns that tell items apart (never null)."""
    key = list(key)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    sizes = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())   # at most GRAM numbers
    passed = items.join(open_to_all, feed, "left_semi")
    if not sizes:
        return passed
    grams = F.concat(*[grams_of(text, n) for n in sizes])
    names = list(dict.fromkeys([feed, *key]))
    found = (items.select(*names, F.explode(grams).alias("gram")).join(index, [feed, "gram"])
             .select(*names, "keyword").distinct())
    hits = items.select(*names, text.alias("_text")).join(found, names).where(F.contains("_text", F.col("keyword")))
    rest = items.join(open_to_all, feed, "left_anti").join(hits.select(*names).distinct(), names, "left_semi")
    return passed.unionByName(rest.select(*passed.columns))
