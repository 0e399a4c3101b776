"""Value objects: snapshot and search filter."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Snapshot:
    """A pinned view: rows of one dataset generation with ``seq <= max_seq``."""

    generation: str
    max_seq: int
    captured_at: str = ""

    def of(self, events: DataFrame) -> DataFrame:
        return events.filter(F.col("seq") <= self.max_seq)


@dataclass
class Filter:
    """Search filter; every atom treats NULL and '' alike and is two-valued.

    ``expr`` is a tree of dicts: ``{"t": "and"|"or", "nodes": [...]}``,
    ``{"t": "not", "node": ...}``, ``{"t": "cmp", "field", "op", "value"}`` or
    ``{"t": "text", "value", "regex"}``.
    """

    includes: dict[str, list[str]] = field(default_factory=dict)
    excludes: dict[str, list[str]] = field(default_factory=dict)
    exists: list[str] = field(default_factory=list)
    match_none: bool = False
    errors_only: bool = False
    hide_read_only: bool = False
    from_ms: int = 0
    to_ms: int = 0
    text: str = ""
    expr: dict[str, Any] | None = None

    def column(self) -> Column:
        from .operators.search import filter_column
        return filter_column(self)
