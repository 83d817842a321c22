"""Clustered table layout by a space-filling order.

Every clustering column is cut into 2**``bits`` buckets at the quantiles of a bounded sample; the buckets' bits are
interleaved into one key, and rows are range-partitioned and sorted by it.  Files then cover small boxes of all
columns at once, so a filter on any of them admits few files by their min/max statistics (one sort column would help
filters on that column only).  The sample decides the layout's quality, never a result.

``write_clustered`` reads its input three times (sample, range bounds, write), so give it a stored table;
``compact_clustered`` rewrites a stored table, as a maintenance job does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 10_000     # rows that decide the bucket bounds
BITS = 5                 # 32 buckets a column
SEED = 7


def bucket_bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE_ROWS) -> dict[str, list]:
    """Per column the ascending values at which buckets begin (fewer for few distinct values)."""
    rows = df.select(*columns).orderBy(F.rand(SEED)).limit(sample).collect()
    bounds = {}
    for c in columns:
        values = sorted(r[c] for r in rows if r[c] is not None)
        distinct = sorted(set(values))
        if len(distinct) <= 1 << bits:
            bounds[c] = distinct[1:]
        else:
            cuts = {values[len(values) * k >> bits] for k in range(1, 1 << bits)}
            bounds[c] = sorted(cuts - {distinct[0]})
    return bounds


def bucket(column: str, bounds: Sequence) -> Column:
    """The number of bounds at or below the value (binary search as nested conditions); null is 0."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))
    return F.when(F.col(column).isNull(), 0).otherwise(pick(0, len(bounds)))


def interleaved(buckets: Sequence[Column], bits: int = BITS) -> Column:
    """One key of the buckets' bits, the highest of every column first."""
    key = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for own in buckets:
            key = key * 2 + F.shiftright(own.cast("long"), b).bitwiseAND(1)
    return key


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = BITS) -> None:
    """Write ``df`` as at most ``files`` Parquet files clustered by ``columns``."""
    bounds = bucket_bounds(df, columns, bits)
    # few buckets are spread over all numbers, so that their first bit halves them too
    parts = [F.floor(bucket(c, bounds[c]) * (1 << bits) / (len(bounds[c]) + 1)) for c in columns]
    keyed = df.withColumn("_cluster", interleaved(parts, bits))
    order = ["_cluster", *columns]
    (keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_cluster")
     .write.mode("overwrite").parquet(path))


def compact_clustered(spark: SparkSession, source: str, target: str, columns: Sequence[str], files: int) -> None:
    """Rewrite the table at ``source`` as a clustered one at ``target`` (another path: readers of ``source`` go on)."""
    write_clustered(spark.read.parquet(source), target, columns, files)


def file_ranges(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per file of a stored table: rows, and the least and largest value of every column."""
    facts = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *facts)


def admitting(ranges: DataFrame, **wanted) -> DataFrame:
    """The files whose ranges admit the given values (a value, or a (low, high) pair)."""
    for c, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        ranges = ranges.where((F.col(f"least_{c}") <= F.lit(high)) & (F.col(f"most_{c}") >= F.lit(low)))
    return ranges
