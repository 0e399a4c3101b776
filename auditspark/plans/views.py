"""Results by name for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.resources import resource_refs
from ..operators import aggregates, diff, lineage, maintain


def register_views(spark: SparkSession, events: DataFrame, observations: DataFrame, prefix: str = "") -> list[str]:
    """Register the stored tables and the results without arguments as temporary views; returns their names.

    Views are lazy: a result is computed by the statement that reads it.
    """
    views = {
        "events": events, "observations": observations, "evidence_stats": maintain.evidence_stats(events, observations),
        "evidence_pages": maintain.evidence_pages(events, observations), "search_stats": aggregates.stats(events), "search_facets": aggregates.facets(events),
        "search_histogram": aggregates.histogram(events), "activity_stats": aggregates.activity_stats(events), "key_activity": aggregates.key_activity(events),
        "role_activity": aggregates.role_activity(events), "key_identities": aggregates.key_identities(events), "hunt_scope": aggregates.hunt_scope(events),
        "resource_references": resource_refs(events), "issuers": lineage.resolve_issuers(events, observations), "child_keys": lineage.children(events, observations),
        "lineage_edges": lineage.lineage_edges(events, observations), "lineage_nodes": lineage.lineage_nodes(events, observations),
        "credential_activity": lineage.credential_activity(events), "field_profile": diff.field_profile(events), "version_pairs": diff.version_pairs(observations),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in views]
