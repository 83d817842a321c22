"""G1: pages at any depth from a stored rank index.

``ORDER BY … LIMIT n OFFSET m`` gathers m + n rows in one place.  ``write_ranked`` stores a table once in the
page order instead: range-partitioned, one folder ``_range=k`` per range, with every row's place ``_pos`` inside its
range, and beside it the number of rows per range.  A page then reads only the ranges that it covers:

* without filters, the stored counts say which range holds which ranks, and ``_pos`` picks the rows;
* with filters, one aggregate counts the matching rows per range (it reads the filters' columns only), and a
  window numbers the matching rows inside the covered ranges.

No plan has a limit or a sort above the rows of the covered ranges; what reaches the driver is one count per
range.  The order must end with a unique tie-break, so that ranks don't depend on how ranges were cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION_BITS = 33      # of monotonically_increasing_id: the rows below them are numbered within a partition


def _rank_in_task() -> Column:
    return F.monotonically_increasing_id().bitwiseAND((1 << PARTITION_BITS) - 1)


def write_ranked(df: DataFrame, path: str, order: Sequence[Column], ranges: int) -> None:
    """Store ``df`` in the order of its pages, cut into at most ``ranges`` ranges."""
    placed = (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id()).withColumn("_pos", _rank_in_task()))
    spark, schema = df.sparkSession, _with_place(df)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/schema")
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    (spark.read.schema(schema).parquet(f"{path}/rows").groupBy("_range")
     .agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts"))


def _with_place(df: DataFrame):
    return T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType()), T.StructField("_range", T.IntegerType())])


def ranked_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their places; the schema is stored too, so an empty table reads as well."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


class RankIndex:
    """Pages of a table stored by ``write_ranked``."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = ranked_rows(spark, path)
        self.counts = spark.read.parquet(f"{path}/counts")

    def total(self) -> DataFrame:
        """One row: the number of rows, from the stored counts."""
        return self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    @staticmethod
    def _covered(counts: DataFrame, offset: int, limit: int) -> list[tuple[int, int, int]]:
        """(range, first, end) of the ranks from ``offset`` on that lie in each range; one row a range is collected."""
        out, start = [], 0
        for k, n in sorted((r["_range"], r["n"]) for r in counts.collect()):
            first, end = max(offset - start, 0), min(offset + limit - start, n)
            if first < end:
                out.append((k, first, end))
            start += n
        return out

    def page(self, offset: int, limit: int, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The ``limit`` rows from rank ``offset`` on (of those that ``where`` keeps), with ``_range`` and ``_pos`` for their order."""
        matching = self.rows if where is None else where(self.rows)
        counts = self.counts if where is None else matching.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        covered = self._covered(counts, offset, limit)
        some = matching.where(F.col("_range").isin([k for k, _, _ in covered]) if covered else F.lit(False))
        place = "_pos"
        if where is not None:
            place = "_nth"
            some = some.withColumn(place, F.row_number().over(Window.partitionBy("_range").orderBy("_pos")) - 1)
        wanted = F.lit(False)
        for k, first, end in covered:
            wanted = wanted | ((F.col("_range") == k) & (F.col(place) >= first) & (F.col(place) < end))
        return some.where(wanted).drop("_nth")


def in_order(page: DataFrame) -> DataFrame:
    """A page's rows in their order, without the columns that say it (a page is small: one task sorts it)."""
    return page.coalesce(1).sortWithinPartitions("_range", "_pos").drop("_range", "_pos")
