"""Case-insensitive title search through trigram posting lists.

``contains(lower(title), needle)`` reads every title.  ``write_title_index`` stores, beside a table kept in ranges
(``pages.write_ranked``), one posting (gram, _range, _pos) per distinct trigram of every lower-cased title,
sorted by gram, so that a needle's grams touch few row groups.  A search intersects the needle's postings by a count; the
candidates' ranges prune the table's folders before any title is read (dynamic partition pruning), the candidates' places pick the rows, and
``contains`` verifies them.  Needles below three characters have no trigram: every title is read, as before.

A gram that stands in a large share of the titles has a long posting list, but a list is only ever counted by
place in a partial aggregate, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.text import contains_ci, grams
from pulse.operators.pages import ranked_rows, write_ranked

GRAM = 3


def needle_grams(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def write_title_index(df: DataFrame, path: str, order: Sequence[Column], ranges: int, title: str = "title") -> None:
    """Store ``df`` in ``ranges`` ranges of ``order`` and the postings of its titles."""
    write_ranked(df, path, order, ranges)
    rows = ranked_rows(df.sparkSession, path)
    (rows.select(F.explode(grams(F.lower(F.col(title)), GRAM)).alias("gram"), "_range", "_pos")
     .repartitionByRange(ranges, "gram", "_range").sortWithinPartitions("gram", "_range", "_pos")
     .write.mode("overwrite").parquet(f"{path}/postings"))


class TitleIndex:
    def __init__(self, spark: SparkSession, path: str, title: str = "title"):
        self.rows, self.postings, self.title = ranked_rows(spark, path), spark.read.parquet(f"{path}/postings"), title

    def candidates(self, needle: str) -> DataFrame | None:
        """Places (_range, _pos) of the titles that hold every trigram of ``needle``; None if it has none."""
        grams = needle_grams(needle)
        if not grams:
            return None
        return (self.postings.where(F.col("gram").isin(grams)).groupBy("_range", "_pos").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") == len(grams)).select("_range", "_pos"))

    def search(self, needle: str) -> DataFrame:
        """The rows whose title contains ``needle``, whatever the case."""
        if not needle:
            return self.rows.drop("_range", "_pos")
        places = self.candidates(needle)
        found = self.rows if places is None else self.rows.join(places, ["_range", "_pos"], "left_semi")
        return found.where(contains_ci(F.col(self.title), needle)).drop("_range", "_pos")
