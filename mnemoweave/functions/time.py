"""Times are whole seconds since 1970 in UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["day", "day_in_text", "day_seconds", "iso_seconds", "cli_seconds"]

#: The spellings of a date that are read.
_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy")
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"


def day(seconds: Column, missing: str | None = None) -> Column:
    """``YYYY-MM-DD``; ``missing`` for null and years outside 1 to 9999."""
    held = seconds.between(-62135596800, 253402300799)
    return F.when(held, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(F.lit(missing))


def day_seconds(text: Column) -> Column:
    """UTC midnight of a date in one of five spellings, else null."""
    return F.unix_seconds(F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in _FORMATS)))


def day_in_text(text: Column) -> Column:
    """UTC midnight of the first ISO date in a text, else of the first written one, else null."""
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    written = F.regexp_extract(text, rf"(?i)\b((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", 1)
    return F.coalesce(F.when(iso != "", day_seconds(iso)), F.when(written != "", day_seconds(F.regexp_replace(written, r"\s+", " "))))


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 time with Z or an offset; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def cli_seconds(text: str | None) -> int | None:
    """A ``YYYY-MM-DD`` argument; None for a blank one, ValueError for any other."""
    if not text or not text.strip():
        return None
    return int(datetime.strptime(text.strip(), "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())
