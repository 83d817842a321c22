"""Label buckets and rank orders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.schemas import RISK_ORDER, SEVERITY_ORDER


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_bucket(c, threshold: float = 0.05, unknown: str | None = None) -> Column:
    """positive if ≥ t, negative if ≤ −t, else neutral.

    The gold datasets use t = 0.05 and send NULL to 'neutral'; the dashboards use
    t = 0.1 and show NULL as ``unknown`` (pass ``unknown='unknown'``).
    """
    x = _c(c)
    e = (F.when(x >= threshold, "positive").when(x <= -threshold, "negative")
         .otherwise("neutral"))
    return F.when(x.isNull(), F.lit(unknown)).otherwise(e) if unknown is not None else e


def alignment_band(c) -> Column:
    """aligned (≥ 7), partial (≥ 4), divergent (< 4), NULL stays NULL."""
    x = _c(c)
    return F.when(x >= 7, "aligned").when(x >= 4, "partial").when(x.isNotNull(), "divergent")


def severity_rank(c) -> Column:
    """critical 1, high 2, medium 3, low 4, anything else (NULL too) 5."""
    x = _c(c)
    e = F.lit(5)
    for i, s in reversed(list(enumerate(SEVERITY_ORDER, start=1))):
        e = F.when(x == s, F.lit(i)).otherwise(e)
    return e


def risk_rank(c) -> Column:
    """Low 1 < Medium 2 < High 3 < Critical 4; unknown → NULL."""
    x = _c(c)
    e = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(RISK_ORDER, start=1))):
        e = F.when(x == s, F.lit(i)).otherwise(e)
    return e


def risk_from_rank(c) -> Column:
    x = _c(c)
    e = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(RISK_ORDER, start=1))):
        e = F.when(x == i, F.lit(s)).otherwise(e)
    return e
