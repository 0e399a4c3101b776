"""Facts of a record that operators ask for beside the event columns, extracted once and stored as one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .labels import acted_on_parsed
from .resources import reference_array

# Maps and lists stay text inside: one odd member must not lose the others.
_RECORD = ("sharedEventID string, requestID string, resources array<string>, requestParameters map<string,string>, userIdentity map<string,string>, "
           "responseElements struct<credentials:struct<expiration:string>,federatedUser:struct<arn:string>>")


def _facts(r: Column, read_only: Column) -> Column:
    """Struct of the facts of a parsed record; readOnly counts only as a JSON boolean."""
    session = F.try_element_at(r["userIdentity"], F.lit("sessionContext"))
    request = lambda name: F.try_element_at(r["requestParameters"], F.lit(name))
    return F.struct(
        read_only["readOnly"].alias("recordedReadOnly"),
        r["sharedEventID"].alias("sharedID"), r["requestID"].alias("requestID"),
        # a member that is present with a null value counts as present
        F.coalesce(F.map_contains_key(r["userIdentity"], "sessionContext"), F.lit(False)).alias("hasContext"),
        F.get_json_object(session, "$.attributes.mfaAuthenticated").alias("mfa"),
        r["responseElements"]["credentials"]["expiration"].alias("expiration"), r["responseElements"]["federatedUser"]["arn"].alias("federatedArn"),
        request("roleArn").alias("targetRole"), request("targetPrincipal").alias("targetPrincipal"),
        reference_array(r["resources"], r["requestParameters"]).alias("refs"), acted_on_parsed(r["resources"], r["requestParameters"]).alias("actedOn"))


def with_facts(events: DataFrame) -> DataFrame:
    """Events with ``facts``: the stored column, or extracted from ``raw`` where none is stored.

    The parsed record is a column of its own, so that it is made once for all facts taken from it.
    """
    if "facts" in events.columns:
        return events
    parsed = events.withColumns({"_r": F.from_json("raw", _RECORD), "_readOnly": F.from_json("raw", "readOnly boolean")})
    return parsed.withColumn("facts", _facts(F.col("_r"), F.col("_readOnly"))).drop("_r", "_readOnly")
