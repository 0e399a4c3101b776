"""Time text to instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted spellings besides RFC 3339.
CONSOLE_FORMATS = ("MMM d, yyyy, h:mm:ss a", "MMM d, yyyy h:mm:ss a", "MMM d, yyyy, HH:mm:ss")

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$"


def event_ts(text: Column) -> Column:
    """Recorded event time as TIMESTAMP, NULL when unusable.

    The pattern gate is needed because Spark would read '2025' as a date.
    """
    return F.when(text.rlike(_RFC3339), F.upper(text).try_cast("timestamp"))


def event_ms(text: Column) -> Column:
    return F.unix_millis(event_ts(text))


def evidence_ms(text: Column) -> Column:
    """RFC 3339 or one of the console spellings, as epoch milliseconds."""
    return F.coalesce(event_ms(text), *[
        F.when(text.rlike(r"^[A-Z][a-z]{2} \d"), F.unix_millis(F.try_to_timestamp(text, F.lit(fmt)))) for fmt in CONSOLE_FORMATS
    ])


# DuckDB-compatible origin for bucket edges: Monday 2000-01-03.
BUCKET_ORIGIN_S = 946857600
