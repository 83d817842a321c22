"""Date helpers: publish-time normalisation, trailing windows, calendar buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date_lit(d) -> Column:
    """A date as a Column; None is today."""
    if d is None:
        return F.current_date()
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def published_at(published_date, scraped_at) -> Column:
    """Parsed publish time (ISO forms only; anything else is NULL) else scrape time."""
    return F.coalesce(F.try_to_timestamp(_c(published_date)), _c(scraped_at))


def since(days: int, as_of, cap: int | None = None) -> Column:
    """The first date of a trailing window: ``as_of − min(days, cap)``."""
    n = min(days, cap) if cap is not None else days
    return F.date_sub(as_date_lit(as_of), n)


def period(c, granularity: str = "week") -> Column:
    """Calendar bucket (day | week (Monday) | month) as DATE; unknown → week."""
    g = granularity if granularity in ("day", "week", "month") else "week"
    return F.to_date(F.date_trunc(g, _c(c)))
