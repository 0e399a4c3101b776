"""Complete resource names recorded on an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COMPLETE_ARN = r"(?d)\Aarn:[^:]+:[^:]+:[^:]*:[^:]*:.+\z"

_REF = "struct<arn:string,kind:string,source:string>"


def reference_array(resources: Column, parameters: Column) -> Column:
    """array<struct<arn, kind, source>> from resources[] and top-level request strings."""
    complete = lambda text: F.coalesce(text.rlike(COMPLETE_ARN), F.lit(False))
    listed = F.transform(resources, lambda x, i: F.struct(
        F.get_json_object(x, "$.ARN").alias("arn"), F.coalesce(F.get_json_object(x, "$.type"), F.lit("")).alias("kind"),
        F.concat(F.lit("resources["), i.cast("string"), F.lit("].ARN")).alias("source")))
    request = F.transform(F.filter(F.map_entries(parameters), lambda e: complete(e["value"])), lambda e: F.struct(
        e["value"].alias("arn"), F.lit("Request reference").alias("kind"),
        F.concat(F.lit("requestParameters"), F.to_json(F.array(e["key"]))).alias("source")))
    empty = F.array().cast(f"array<{_REF}>")
    return F.concat(F.coalesce(F.filter(listed, lambda r: complete(r["arn"])), empty), F.coalesce(request, empty))


def resource_refs(events: DataFrame) -> DataFrame:
    """One row per recorded reference: seq, arn, kind, source."""
    from .facts import with_facts
    return with_facts(events).select("seq", F.inline_outer("facts.refs")).filter("arn IS NOT NULL")
