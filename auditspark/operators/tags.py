"""Tags from small or large lookup tables: sensitive operations and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small_table

CATALOG_SCHEMA = "event_name string, service string, category string, severity string, default_flag boolean, note string"
#: Our own catalog of operations worth a look: (service, category, severity, note) and the operations it covers.
_GROUPS = {
    ("cloudtrail", "evidence", "high", "The audit trail is stopped, removed or narrowed."): "StopLogging DeleteTrail UpdateTrail PutEventSelectors",
    ("guardduty", "evidence", "high", "Detection is switched off."): "DeleteDetector UpdateDetector StopMonitoringMembers",
    ("logs", "evidence", "medium", "Stored log data is removed."): "DeleteLogGroup DeleteLogStream PutRetentionPolicy",
    ("iam", "standing access", "high", "A lasting credential is made."): "CreateAccessKey CreateLoginProfile UpdateLoginProfile CreateUser",
    ("iam", "rights", "high", "What an identity may do is widened."): "AttachUserPolicy AttachRolePolicy AttachGroupPolicy PutUserPolicy PutRolePolicy PutGroupPolicy "
                                                                      "CreatePolicyVersion SetDefaultPolicyVersion UpdateAssumeRolePolicy AddUserToGroup",
    ("iam", "second factor", "medium", "A second factor is taken away."): "DeactivateMFADevice DeleteVirtualMFADevice",
    ("sts", "sessions", "low", "A session is handed out."): "AssumeRole GetSessionToken GetFederationToken AssumeRoot",
    ("secretsmanager", "secrets", "high", "A secret is read or changed."): "GetSecretValue BatchGetSecretValue PutSecretValue DeleteSecret",
    ("ssm", "secrets", "medium", "A stored parameter is read."): "GetParameter GetParameters GetParametersByPath",
    ("kms", "secrets", "medium", "A key stops working or gets other users."): "DisableKey ScheduleKeyDeletion PutKeyPolicy CreateGrant",
    ("s3", "exposure", "high", "Who may reach a bucket is changed."): "PutBucketPolicy PutBucketAcl DeletePublicAccessBlock PutBucketPublicAccessBlock",
    ("s3", "loss", "medium", "Data or its protection is removed."): "DeleteBucket DeleteObjects PutBucketVersioning PutLifecycleConfiguration",
    ("ec2", "network", "medium", "A way into the network is opened."): "AuthorizeSecurityGroupIngress CreateNetworkAclEntry CreateVpcPeeringConnection ModifyImageAttribute ModifySnapshotAttribute",
    ("ec2", "machines", "low", "Machines are started or stopped."): "RunInstances TerminateInstances StopInstances",
    ("lambda", "code", "medium", "Code that runs by itself is changed."): "UpdateFunctionCode AddPermission CreateFunction",
    ("organizations", "accounts", "high", "An account or its guard rails change."): "LeaveOrganization DetachPolicy DisablePolicyType RemoveAccountFromOrganization",
    ("signin", "sessions", "low", "Someone signs in."): "ConsoleLogin SwitchRole",
}
LABEL_KINDS = {"arn", "account", "address"}


def default_catalog(spark: SparkSession) -> DataFrame:
    """The catalog that ships with the package; high and medium rows are on by default."""
    rows = [(name, service, category, severity, severity != "low", note)
            for (service, category, severity, note), names in _GROUPS.items() for name in names.split()]
    return small_table(spark, rows, CATALOG_SCHEMA)


def _names(catalog: DataFrame, values: Iterable[str]) -> DataFrame:
    return small_table(catalog.sparkSession, [(v.lower(),) for v in values], "_name string")


def effective_catalog(catalog: DataFrame, add: Iterable[str] = (), remove: Iterable[str] = ()) -> DataFrame:
    """Catalog rows keyed by lower-case name with the effective ``sensitive`` flag.

    High and medium rows are sensitive by default; the add/remove lists are a
    delta on top, so a newer catalog keeps its own defaults.
    """
    base = catalog.withColumn("_name", F.lower("event_name"))
    extra = _names(catalog, set(add)).join(base, "_name", "left_anti")
    added, removed = [v.lower() for v in add], [v.lower() for v in remove]
    flag = (F.col("severity").isin("high", "medium") | F.col("_name").isin(added)) & ~F.col("_name").isin(removed)
    return base.unionByName(extra, allowMissingColumns=True) \
        .withColumn("sensitive", F.coalesce(flag, F.col("_name").isin(added) & ~F.col("_name").isin(removed))) \
        .dropDuplicates(["_name"])


def tag_sensitive(events: DataFrame, catalog: DataFrame, add: Iterable[str] = (), remove: Iterable[str] = ()) -> DataFrame:
    """Left join with the catalog; Spark broadcasts it while it is small."""
    tagged = effective_catalog(catalog, list(add), list(remove)).select("_name", "sensitive", "service", "category", "severity", "note")
    return events.join(tagged, F.lower(F.coalesce("eventName", F.lit(""))) == F.col("_name"), "left").drop("_name") \
        .withColumn("sensitive", F.coalesce("sensitive", F.lit(False)))


def sensitive_only(events: DataFrame, catalog: DataFrame, add: Iterable[str] = (), remove: Iterable[str] = (),
                   chosen: Iterable[str] = ()) -> DataFrame:
    """Only sensitive operations, narrowed to ``chosen`` names; an empty intersection matches nothing."""
    keep = effective_catalog(catalog, list(add), list(remove)).filter("sensitive").select("_name")
    chosen = [v.lower() for v in chosen]
    if chosen:
        keep = keep.filter(F.col("_name").isin(chosen))
    return events.join(keep, F.lower(F.coalesce("eventName", F.lit(""))) == F.col("_name"), "left_semi")


def annotate(rows: DataFrame, labels: DataFrame, kind: str, column: str, name: str = "label") -> DataFrame:
    """Exact (kind, value) label of a column."""
    if kind not in LABEL_KINDS:
        raise ValueError(f"unknown label kind {kind!r}")
    wanted = labels.filter(F.col("kind") == kind).select(F.col("value").alias("_value"), F.col("label").alias(name))
    return rows.join(wanted, F.col(column) == F.col("_value"), "left").drop("_value")
