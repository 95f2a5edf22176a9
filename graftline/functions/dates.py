"""Dates of posts (F-D1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def created_at(c: Column) -> Column:
    """Timestamp of text like ``Wed Dec 20 10:35:09 +0800 2023``; the weekday is cut off, white space collapsed; else null."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^\s*[A-Za-z]{3} ", "")
    return F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss Z yyyy"))
