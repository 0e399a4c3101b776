"""Pages over the event table; ``seq`` is the page key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import Filter, Snapshot
from .aggregates import facets, histogram, stats
from .search import apply_filter

PAGE, NEWER = 200, 500


def page(events: DataFrame, f: Filter | None = None, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Newest first; runs as TakeOrdered, so each task keeps ``offset + limit`` rows."""
    out = apply_filter(events, f).orderBy(F.col("seq").desc())
    return (out.offset(offset) if offset > 0 else out).limit(limit if limit > 0 else PAGE)


def newer(events: DataFrame, f: Filter | None, since_seq: int, limit: int = NEWER) -> DataFrame:
    """Oldest rows not seen yet, shown newest first."""
    oldest = apply_filter(events.filter(F.col("seq") > since_seq), f).orderBy("seq").limit(limit if limit > 0 else NEWER)
    return oldest.orderBy(F.col("seq").desc())


def page_before(events: DataFrame, f: Filter | None, snapshot: Snapshot, before: int = 0, limit: int = PAGE) -> DataFrame:
    """Keyset page on a pinned snapshot."""
    rows = snapshot.of(events)
    if before > 0:
        rows = rows.filter(F.col("seq") < before)
    return apply_filter(rows, f).orderBy(F.col("seq").desc()).limit(limit if limit > 0 else PAGE)


def search(events: DataFrame, f: Filter | None, snapshot: Snapshot, limit: int = PAGE) -> dict[str, DataFrame]:
    """Summaries and first page of one search on one snapshot."""
    pinned = snapshot.of(events)
    return {"stats": stats(pinned, f), "facets": facets(pinned, f), "histogram": histogram(pinned, f),
            "page": page_before(events, f, snapshot, 0, limit)}
