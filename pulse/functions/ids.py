"""Deterministic identifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 name-space id for URLs (fixed value).
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uuid5_url(c) -> Column:
    """``uuid.uuid5(uuid.NAMESPACE_URL, url)`` computed on executors.

    SHA-1 over namespace bytes + UTF-8 name, first 16 bytes, version nibble 5,
    RFC 4122 variant bits, 8-4-4-4-12 layout.
    """
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL_HEX)), F.encode(_c(c), "UTF-8")))
    variant = F.lower(F.conv(
        ((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)))
         .bitwiseOR(F.lit(8))).cast("string"), 10, 16))
    u = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant,
                 F.substring(h, 18, 15))
    out = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4),
                      F.substring(u, 17, 4), F.substring(u, 21, 12))
    return F.when(_c(c).isNotNull(), out)


def url_hash(c) -> Column:
    """Stable URL hash (SHA-256 hex); the process-salted hash of the reference is not reproducible."""
    return F.sha2(_c(c), 256)


def sha_key(*parts, sep: str = "|") -> Column:
    """SHA-256 over ``concat(p1, sep, p2, ...)``; NULL if any part is NULL (SQL CONCAT semantics)."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(sep))
        cols.append(_c(p))
    return F.sha2(F.concat(*cols), 256)
