"""Text functions: white space, missing text, stable ids, words about the future."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The missing-text pattern, and the fifteen words that tell of the future.
MISSING = r"(?iU)^\s*(?:NA\b.*)?$"
FUTURE_WORDS = ("forecast", "predict", "predicted", "prediction", "project", "projected", "projection", "expect", "expected", "expects", "outlook", "likely", "will", "could", "may")


def normalise(text: Column) -> Column:
    """White space of any kind joined to one space and trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def is_valid(text: Column) -> Column:
    """Whether a text says anything: not null, blank, or NA with what follows on the line."""
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(MISSING))


def tells_future(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"(?i)\b(?:" + "|".join(FUTURE_WORDS) + r")\b")), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
