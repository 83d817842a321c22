"""Exact grouped median with bounded memory per group.

``percentile`` keeps a value→count map per group, which grows with the data when a
continuous column has a group that holds a large share of the rows.  ``grouped_median``
gives the same exact result (linear interpolation between the two middle order
statistics, NULLs ignored) in two scans, with one path for every group size:

1. A fixed-size quantile sketch per group (``percentile_approx``, rank error at most
   n / ``ACCURACY``) gives two values that are certain to enclose the middle ranks.
2. The second scan counts the values below, and each value between the two.  That is
   a partial aggregate; at most a few ten-thousandths of a group's rows lie between.  A running
   count over them finds the two middle values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of ``value`` per ``keys`` (the same result as ``percentile(value, 0.5)``).

    Returns one row per group with at least one non-NULL value.  Left-join it
    to the group's other aggregates (null-safe on the keys)."""
    g = [f"_g{i}" for i in range(len(keys))]
    v = F.col(value).cast("double") + F.lit(0.0)        # -0.0 and 0.0 are one value
    rows = (df.where(F.col(value).isNotNull())
            .select(*[F.col(k).alias(a) for k, a in zip(keys, g)], v.alias("_v")))
    # two sketch errors off the middle on either side: the true middle ranks lie between
    margin = 2.0 / ACCURACY
    sketch = rows.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], ACCURACY).alias("_q"))
    bounds = sketch.select(*[F.col(a).alias(f"_b{a}") for a in g], "_n", F.col("_q")[0].alias("_lo"),
                           F.col("_q")[1].alias("_hi"))
    same = F.lit(True)
    for a in g:
        same = same & F.col(a).eqNullSafe(F.col(f"_b{a}"))
    at = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))   # NULL: all that is below
    counts = (rows.join(bounds, same).where(F.col("_v") <= F.col("_hi"))
              .groupBy(*g, "_n", at.alias("_at")).agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy(*g).orderBy(F.col("_at").asc_nulls_first())
    upto = counts.withColumn("_upto", F.sum("_c").over(order))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1    # middle ranks, from 1

    def value_at(rank):
        return F.min(F.when((F.col("_upto") >= rank) & F.col("_at").isNotNull(), F.col("_at")))
    middle = upto.groupBy(*g).agg(value_at(first).alias("_a"), value_at(second).alias("_b"))
    med = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b"))
    return middle.select(*[F.col(a).alias(k) for a, k in zip(g, keys)], med.alias(out))
