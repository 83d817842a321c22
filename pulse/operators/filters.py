"""Filters, paging and top-k building blocks.

Filters use bound literals (never SQL text), so they are injection-free and
push down to Parquet where the predicate allows (equality, ranges, IN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.dates import as_date_lit
from pulse.functions.text import contains_ci

# Optional filter name → column it constrains (equality filters).
EQUALITY_FILTERS = {
    "esg_category": "esg_category",
    "source_type": "source_type",
    "sentiment": "sentiment_label",
    "stance": "stance",
    "severity": "severity",
    "event_type": "event_type",
    "claim_type": "claim_type",
}


def apply_filters(df: DataFrame, date_col: str = "scraped_date", *,
                  date_from=None, date_to=None, search: str | None = None,
                  score_col: str | None = None, min_score=None, max_score=None,
                  **equals) -> DataFrame:
    """Conjunction of the given optional filters; absent (None/empty) ones are no-ops."""
    for name, value in equals.items():
        if value in (None, ""):
            continue
        col = EQUALITY_FILTERS.get(name, name)
        df = df.where(F.col(col) == F.lit(value))
    if date_from:
        df = df.where(F.col(date_col) >= as_date_lit(date_from))
    if date_to:
        df = df.where(F.col(date_col) <= as_date_lit(date_to))
    if search:
        df = df.where(contains_ci(F.col("title"), search))
    if score_col and min_score is not None:
        df = df.where(F.col(score_col) >= F.lit(min_score))
    if score_col and max_score is not None:
        df = df.where(F.col(score_col) <= F.lit(max_score))
    return df


def clamp(value: int, lo: int, hi: int) -> int:
    """G8 argument validation (limits, offsets, day windows)."""
    if value < lo or value > hi:
        raise ValueError(f"value {value} outside [{lo}, {hi}]")
    return value


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """G1: ORDER BY … LIMIT/OFFSET (``order`` must end with a unique tie-break)."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def few_sorted(df: DataFrame, *order) -> DataFrame:
    """ORDER BY for an aggregate whose groups are few by nature (categories, weeks, severities): one task sorts
    them, without the sampling job and the range exchange of a distributed sort."""
    return df.coalesce(1).sortWithinPartitions(*order)


def count_rows(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top-N rows (TakeOrderedAndProject: per-partition top-N, then merge)."""
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, key: list[str], order: list[Column],
                  latest: bool = False) -> DataFrame:
    """The row with the smallest (``latest``: largest) ``order`` per key.

    ``min_by``/``max_by`` over a struct of the order columns is a partial
    aggregate: every map task reduces a key to one row before the shuffle, so
    a key holding a third of all rows costs one row per task, not a third of
    the data in one task (a window over the key would sort it all in one task).
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if latest else F.min_by
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*key).agg(pick(row, F.struct(*order)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns))


def cap_per_group(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group (partial group limit before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
