"""Event columns extracted from the JSON text of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .times import event_ts

_SCHEMA = (
    "struct<eventID:string,eventTime:string,eventName:string,eventSource:string,awsRegion:string,"
    "sourceIPAddress:string,userAgent:string,errorCode:string,errorMessage:string,recipientAccountId:string,"
    "readOnly:string,managementEvent:string,"
    "userIdentity:struct<type:string,arn:string,userName:string,accountId:string,principalId:string,"
    "accessKeyId:string,invokedBy:string,"
    "sessionContext:struct<sourceIdentity:string,sessionIssuer:struct<arn:string,userName:string>>>,"
    "responseElements:struct<credentials:struct<accessKeyId:string>,assumedRoleUser:struct<arn:string>>>"
)

EVENT_COLUMNS = (
    "eventID", "eventTime", "ts", "eventMs", "eventName", "eventSource", "awsRegion", "sourceIPAddress", "userAgent",
    "identityType", "identityArn", "userName", "accountId", "principalId", "roleArn", "sessionName", "accessKeyId",
    "issuedKeyId", "issuedRoleArn", "invokedBy", "sourceIdentity", "errorCode", "errorMessage", "recipientAccountId",
    "readOnly", "managementEvent",
)

PAGE_COLUMNS = (
    "seq", "eventID", "eventTime", "eventName", "eventSource", "awsRegion", "sourceIPAddress", "userAgent",
    "identityType", "identityArn", "userName", "accountId", "principalId", "roleArn", "sessionName", "errorCode",
    "errorMessage", "recipientAccountId", "readOnly", "managementEvent",
)


def json_text(path: str, raw: str = "raw") -> Column:
    return F.get_json_object(F.col(raw), path)


def variant(raw: str = "raw") -> Column:
    """Parsed record; NULL for invalid text and for duplicate object members."""
    return F.try_parse_json(F.col(raw))


def variant_type(v: Column, path: str = "$") -> Column:
    """VARIANT type name ('STRING', 'BOOLEAN', 'OBJECT<...>', 'ARRAY<...>', ...), NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def variant_string(v: Column, path: str) -> Column:
    """Text at ``path`` only when the member is a JSON string."""
    return F.when(variant_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def extract_events(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the extracted event columns to records; the JSON text is parsed once per row."""
    parsed = records.withColumn("_r", F.from_json(F.col(raw), _SCHEMA))
    r = lambda path: F.col("_r." + path)
    identity, context = "userIdentity.", "userIdentity.sessionContext."
    columns = {
        **{name: r(name) for name in (
            "eventID", "eventTime", "eventName", "eventSource", "awsRegion", "sourceIPAddress", "userAgent",
            "errorCode", "errorMessage", "recipientAccountId")},
        "identityType": r(identity + "type"),
        "identityArn": r(identity + "arn"),
        "userName": F.coalesce(F.nullif(r(identity + "userName"), F.lit("")), r(context + "sessionIssuer.userName")),
        "accountId": r(identity + "accountId"),
        "principalId": r(identity + "principalId"),
        "roleArn": r(context + "sessionIssuer.arn"),
        "sessionName": F.split_part(r(identity + "principalId"), F.lit(":"), F.lit(2)),
        "accessKeyId": r(identity + "accessKeyId"),
        "issuedKeyId": r("responseElements.credentials.accessKeyId"),
        "issuedRoleArn": r("responseElements.assumedRoleUser.arn"),
        "invokedBy": r(identity + "invokedBy"),
        "sourceIdentity": r(context + "sourceIdentity"),
        "readOnly": F.coalesce(r("readOnly").try_cast("boolean"), F.lit(False)),
        "managementEvent": F.coalesce(r("managementEvent").try_cast("boolean"), F.lit(True)),
        "ts": event_ts(r("eventTime")),
    }
    columns["eventMs"] = F.unix_millis(columns["ts"])
    return parsed.withColumns({name: columns[name] for name in EVENT_COLUMNS}).drop("_r")


def has_error() -> Column:
    return (F.coalesce("errorCode", F.lit("")) != "") | (F.coalesce("errorMessage", F.lit("")) != "")
