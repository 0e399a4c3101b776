"""Attribution evidence: recorded source identities, directory users, federation mappings, broker audit."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import identity_store_id
from ..functions.records import json_text
from ..functions.times import event_ms

EVIDENCE = ("source", "method", "nodeKey", "subjectId", "displayName", "userName", "email", "observedAt", "detail")
DIGEST = r"\Ahmac-sha256:[0-9a-f]{64}\z"
_AUDIT = ("type string, time string, error string, auth struct<entity_id:string>, "
          "request struct<id:string,mount_type:string,path:string,operation:string,remote_address:string,headers:map<string,array<string>>>, "
          "response struct<mount_type:string,data:struct<access_key:string,error:string,errors:string>>")


def _given(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def node_key() -> Column:
    """Credential id, else the principal name."""
    return F.coalesce(F.nullif(F.col("accessKeyId"), F.lit("")), F.concat(F.lit("arn:"), F.coalesce("identityArn", F.lit(""))))


def _evidence(df: DataFrame, source: str, method, **columns: Column) -> DataFrame:
    values = {name: columns.get(name, F.lit(None).cast("string")) for name in EVIDENCE}
    values["source"], values["method"] = F.lit(source), method if isinstance(method, Column) else F.lit(method)
    return df.select(*[values[name].cast("string").alias(name) for name in EVIDENCE])


def source_identities(events: DataFrame) -> DataFrame:
    found = events.filter(_given(F.col("sourceIdentity"))).groupBy(node_key().alias("nodeKey"), "sourceIdentity") \
        .agg(F.min("eventTime").alias("at"))
    value = F.col("sourceIdentity")
    return _evidence(found, "source-identity", "recorded-attribute", nodeKey=F.col("nodeKey"), subjectId=value, displayName=value, observedAt=F.col("at"))


def _users(directory: DataFrame, *by: str) -> DataFrame:
    """One row per directory user with the primary (else the first) e-mail."""
    return directory.groupBy(*by).agg(
        F.max("user_name").alias("userName"), F.max("display_name").alias("displayName"),
        F.coalesce(F.min(F.when(F.col("is_primary"), F.col("email"))), F.min("email")).alias("email"))


def directory_identities(events: DataFrame, directory: DataFrame) -> DataFrame:
    """Users whose (store, user) ids the events record; ids are matched exactly, names never."""
    recorded = events.select(node_key().alias("nodeKey"), json_text("$.userIdentity.onBehalfOf.identityStoreArn").alias("storeArn"),
                             json_text("$.userIdentity.onBehalfOf.userId").alias("userId")) \
        .filter(_given(F.col("storeArn")) & _given(F.col("userId"))).distinct().withColumn("store", identity_store_id(F.col("storeArn")))
    users = _users(directory, "store_id", "user_id")
    hit = recorded.join(users, (F.col("store") == F.col("store_id")) & (F.col("userId") == F.col("user_id")))
    return _evidence(hit, "identity-center", "event-recorded-store-user-id", nodeKey=F.col("nodeKey"),
                     subjectId=F.concat("storeArn", F.lit("/user/"), "userId"), displayName=F.col("displayName"),
                     userName=F.col("userName"), email=F.col("email"))


def mapped_sessions(events: DataFrame, mappings: DataFrame, now_ms: int | None = None) -> DataFrame:
    """(nodeKey, session, mapping_id): role sessions inside an attested mapping of their role.

    The mapping must hold at the event time and, when recorded, at session
    creation; of several, the lowest mapping_id counts.
    """
    session = F.regexp_extract("identityArn", r"\Aarn:[^:]*:sts:[^:]*:[^:]*:assumed-role/[^/]+/(?:.*/)?([^/]+)\z", 1)
    created = json_text("$.userIdentity.sessionContext.attributes.creationDate")
    used = events.select("seq", node_key().alias("nodeKey"), session.alias("session"), "roleArn", "eventMs", created.alias("created")) \
        .filter(_given(F.col("session")) & _given(F.col("roleArn")) & F.col("eventMs").isNotNull())
    limits = mappings.select("mapping_id", F.col("roleArn").alias("_role"), event_ms(F.col("validFrom")).alias("start"),
                             event_ms(F.col("validTo")).alias("stop"), event_ms(F.col("verifiedAt")).alias("attested"))
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    limits = limits.filter((F.col("start") < F.col("stop")) & (F.col("attested") <= now) & _given(F.col("_role")))
    within = lambda ms: (ms >= F.col("start")) & (ms < F.col("stop"))
    made = ~_given(F.col("created")) | F.coalesce(within(event_ms(F.col("created"))), F.lit(False))
    matched = used.join(limits, F.col("roleArn") == F.col("_role")).filter(within(F.col("eventMs")) & made)
    return matched.groupBy("nodeKey", "session").agg(F.min("mapping_id").alias("mapping_id"))


def federated_identities(events: DataFrame, mappings: DataFrame, directory: DataFrame, now_ms: int | None = None) -> DataFrame:
    users = _users(directory.withColumn("_name", F.lower("user_name")), "_name", "user_id")
    hit = mapped_sessions(events, mappings, now_ms).join(users, F.lower("session") == F.col("_name"))
    return _evidence(hit, "federation", "attested-role-mapping", nodeKey=F.col("nodeKey"), subjectId=F.col("user_id"),
                     displayName=F.col("displayName"), userName=F.col("userName"), email=F.col("email"),
                     detail=F.concat(F.lit("mapping "), F.col("mapping_id").cast("string")))


#: What an entry of the broker's log must say, and the texts that stand for nothing.
_SAYS = {"type": ("response",), "request.mount_type": ("", "aws"), "response.mount_type": ("", "aws"), "request.operation": ("read", "update")}
_SILENT = ("error", "response.data.error", "response.data.errors")
_NEEDED = ("auth.entity_id", "request.id", "response.data.access_key")
_NOTHING = ("", "null", '""', "[]")


def broker_responses(audit: DataFrame, column: str = "value") -> DataFrame:
    """Successful credential responses in a broker audit log (one JSON text per row)."""
    # a generator keeps the one parse apart from the conditions on its result
    entries = audit.select(F.inline(F.array(F.from_json(F.col(column), _AUDIT))))
    said = lambda name: F.coalesce(F.col(name), F.lit(""))
    path = F.reverse(F.split(said("request.path"), "/", -1))  # <mount>/.../(sts|creds)/<role>
    tests = [said(name).isin(*words) for name, words in _SAYS.items()] + [F.trim(said(name)).isin(*_NOTHING) for name in _SILENT]
    tests += [said(name) != "" for name in _NEEDED]
    tests += [F.concat(said("request.mount_type"), said("response.mount_type")) != "",
              (F.size(path) > 2) & (F.get(path, F.lit(0)) != "") & F.get(path, F.lit(1)).isin("sts", "creds")]
    kept = entries.filter(reduce(and_, [F.coalesce(test, F.lit(False)) for test in tests]))
    return kept.select(
        F.col("request.id").alias("requestId"), F.col("auth.entity_id").alias("entity"), F.col("response.data.access_key").alias("issued"),
        event_ms(F.col("time")).alias("issuedMs"), F.col("time").alias("issuedAt"), F.col("request.path").alias("path"),
        F.col("request.remote_address").alias("remote")).filter(F.col("issuedMs").isNotNull())


def broker_identities(events: DataFrame, audit: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Broker entities that received a key seen in the events, plain or as a digest; the log is read once."""
    plain = broker_responses(audit).withColumn("hashed", F.col("issued").rlike(DIGEST))
    if digests is None:
        plain = plain.withColumn("key", F.when(~F.col("hashed"), F.col("issued")))
    else:
        known = digests.select("digest", "access_key")
        plain = plain.join(known, F.col("hashed") & (F.col("issued") == F.col("digest")), "left") \
            .withColumn("key", F.when(F.col("hashed"), F.col("access_key")).otherwise(F.col("issued")))
    plain = plain.filter(F.col("key").isNotNull()).withColumn(
        "method", F.when(F.col("hashed"), "audit-hmac-issued-access-key").otherwise("exact-issued-access-key"))
    last_seen = events.filter(_given(F.col("accessKeyId"))).groupBy("accessKeyId").agg(F.max("eventMs").alias("lastMs"))
    hit = plain.join(last_seen, F.col("key") == F.col("accessKeyId")).filter(F.col("issuedMs") <= F.col("lastMs"))
    kept = hit.groupBy("requestId", "key", "entity").agg(F.min(F.struct("issuedMs", "issuedAt", "method", "path", "remote")).alias("f"))
    return _evidence(kept, "broker", F.col("f.method"), nodeKey=F.col("key"), subjectId=F.col("entity"), observedAt=F.col("f.issuedAt"),
                     detail=F.concat_ws("; ", F.concat(F.lit("request "), F.col("requestId")), F.concat(F.lit("path "), F.col("f.path"))))


def enrich(events: DataFrame, directory: DataFrame | None = None, mappings: DataFrame | None = None,
           broker_audit: DataFrame | None = None, key_digests: DataFrame | None = None) -> DataFrame:
    """All evidence the given inputs support."""
    parts = [source_identities(events)]
    if directory is not None:
        parts.append(directory_identities(events, directory))
        if mappings is not None:
            parts.append(federated_identities(events, mappings, directory))
    if broker_audit is not None:
        parts.append(broker_identities(events, broker_audit, key_digests))
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_status(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows, subjects and covered keys per source, with the event-time window looked at."""
    span = events.agg(F.struct(F.min("eventMs").alias("fromMs"), F.max("eventMs").alias("toMs")).alias("s")).scalar()
    return evidence.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("subjectId").alias("subjects"), F.count_distinct("nodeKey").alias("keys")) \
        .withColumn("_s", span).select("source", "rows", "subjects", "keys", "_s.fromMs", "_s.toMs")
