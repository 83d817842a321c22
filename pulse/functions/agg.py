"""Aggregate helpers with deterministic results.

``avg_round`` averages in DECIMAL: the sum is exact, so the rounded result
does not depend on how rows were split across partitions or tasks (a double
sum changes in its last bits with the partitioning, which flips rounding
ties from run to run on a cluster).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVG_DECIMAL = "decimal(20,8)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def avg_round(c, digits: int) -> Column:
    """ROUND(AVG(c), digits) with an exact decimal sum; result DOUBLE.  A value that no
    decimal(20,8) holds counts as NULL: one bad model answer never fails the job."""
    return F.round(F.avg(_c(c).try_cast(AVG_DECIMAL)), digits).cast("double")


def avg_round_if(cond: Column, c, digits: int) -> Column:
    return avg_round(F.when(cond, _c(c)), digits)


def sum_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END)."""
    return F.sum(F.when(cond, 1).otherwise(0))


def median(c, accuracy: int | None = None) -> Column:
    """Median of ``c``.

    Exact by default (``percentile``: linear interpolation; its buffer is a
    value→count map, so a group costs its distinct values — bounded for model
    scores, which carry a few decimals).  For columns with an unbounded value
    domain in very large groups pass ``accuracy`` to switch to
    ``percentile_approx`` (a fixed-size sketch per group; returns a data value,
    relative rank error 1/accuracy)."""
    x = _c(c)
    if accuracy is None:
        return F.percentile(x, 0.5)
    return F.percentile_approx(x, 0.5, accuracy).cast("double")
