"""Text column functions (all JVM-side regular expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.schemas import PREVIEW_CHARS

TAG_RE = r"<[^>]+>"
ENTITY_RE = r"&(amp|lt|gt|nbsp|quot);"
# Same result as replacing every ``\s+`` run with one space, but single spaces
# (the common case) are not matched and rewritten.
WS_RE = r"\s{2,}|[\t\n\x0B\f\r]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), TAG_RE, " ")


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), WS_RE, " ")


def detagged(c) -> Column:
    """Tags stripped, whitespace collapsed: the shared first step of clean text and
    preview (one expression, so Catalyst evaluates it once per row for both)."""
    return collapse_ws(strip_tags(c))


def clean_text(c) -> Column:
    """Strip tags, drop the five common entities, collapse whitespace, trim.

    Collapsing before the entity step changes nothing (entities hold no
    whitespace), so the detagged text can be shared with ``preview``."""
    return F.trim(collapse_ws(F.regexp_replace(detagged(c), ENTITY_RE, " ")))


def preview(c, n: int = PREVIEW_CHARS) -> Column:
    """Dashboard preview: tags stripped and blanks collapsed; entities are kept."""
    return F.left(F.trim(detagged(c)), F.lit(n))


# The characters that Python's ``str.strip()`` removes.
PY_WS = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
         "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_py(c) -> Column:
    """Python ``str.strip()`` (``F.trim`` strips spaces only); a character-set trim, no regex."""
    return F.btrim(_c(c), F.lit(PY_WS))


def blank_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive literal substring test (wildcards in ``needle`` stay literal)."""
    return F.contains(F.lower(_c(c)), F.lit(needle.lower()))


def grams(c, size: int) -> Column:
    """The distinct substrings of ``size`` characters; none for shorter texts and null.

    One regular expression with a look-ahead passes over the text once (a substring per place would count characters from the
    start every time)."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(_c(c), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)),
                      F.array().cast("array<string>"))
