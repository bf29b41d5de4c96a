"""Ages of timestamps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age(at: Column, now: Column | None = None) -> Column:
    """The time since ``at`` as an interval."""
    return (F.current_timestamp() if now is None else now) - at


def older_than(at: Column, duration: str, now: Column | None = None) -> Column:
    """Whether more than ``duration`` (such as ``"30 seconds"``) has passed since ``at``; an exact match has not."""
    return at < (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {duration}")
