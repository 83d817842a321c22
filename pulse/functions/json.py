"""Tolerant parsing of model answers (JSON text) into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.schemas import BRIEF_DDL, CLAIMS_DDL, ESG_DDL, SENTIMENT_DDL

FENCE_RE = r"^\s*```[A-Za-z]*\s*|\s*```\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_fence(c) -> Column:
    """Remove a surrounding Markdown code fence (```json ... ```) if present."""
    return F.regexp_replace(_c(c), FENCE_RE, "")


def field(c, name: str) -> Column:
    """One top-level field as text: JSON null → NULL, the text "null" is kept,
    malformed or fenced text → NULL, arrays/objects → their JSON text."""
    return F.get_json_object(_c(c), f"$.{name}")


def parse(c, ddl: str, fenced: bool = False) -> Column:
    """``from_json`` in PERMISSIVE mode; garbage gives a struct of NULLs."""
    src = strip_fence(c) if fenced else _c(c)
    return F.from_json(src, ddl)


def parse_sentiment(c, fenced: bool = False) -> Column:
    return parse(c, SENTIMENT_DDL, fenced)


def parse_esg(c, fenced: bool = False) -> Column:
    return parse(c, ESG_DDL, fenced)


def parse_claims(c, fenced: bool = False) -> Column:
    return parse(c, CLAIMS_DDL, fenced)


def parse_brief(c, fenced: bool = False) -> Column:
    return parse(c, BRIEF_DDL, fenced)


def parse_ok(c) -> Column:
    """K11 flag: the answer is one well-formed JSON object as given (no fence stripping);
    NULL answers are not ok."""
    x = _c(c)
    return F.coalesce(F.get_json_object(x, "$").isNotNull()
                      & F.regexp_replace(x, r"^\s+", "").startswith("{"), F.lit(False))


def null_text_to_null(c) -> Column:
    """Treat the literal text "null" (as some answers spell a missing value) as NULL."""
    return F.nullif(_c(c), F.lit("null"))
