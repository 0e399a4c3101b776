"""Projection of the driver's ``events`` table onto the audit model.

The projection is one SQL text with a few dialect slots, so that a Spark query
and its DuckDB cross-check start from byte-identical rows.  It is map-only: no
join and no shuffle.

``tick_ms`` coarsens the clock so that several events of one identity share a
timestamp; the ordered-sequence operator has special rules for such ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.facts import with_facts
from ..session import shared_folder
from .files import spread

_SPARK = {
    "ms": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "iso": lambda x: f"date_format(timestamp_millis({x}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
    "console": lambda x: f"date_format(timestamp_millis({x}), 'MMM d, yyyy, h:mm:ss a')",
    "explode": "explode(CASE WHEN event_type = 'signup' AND event_id % 6 = 0 THEN array(0, 1) ELSE array(0) END)",
    "div": lambda a, b: f"({a} div {b})",
    "ts": lambda x: f"timestamp_millis({x})",
}
_DUCK = {
    "ms": "epoch_us(ts) // 1000",
    "iso": lambda x: f"strftime(make_timestamp(({x}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')",
    "console": lambda x: f"strftime(make_timestamp(({x}) * 1000), '%b %-d, %Y, %-I:%M:%S %p')",
    "explode": "unnest(CASE WHEN event_type = 'signup' AND event_id % 6 = 0 THEN [0, 1] ELSE [0] END)",
    "div": lambda a, b: f"({a} // {b})",
    "ts": lambda x: f"make_timestamp(({x}) * 1000)",
}


def _text(d: dict, source: str, tick_ms: int) -> str:
    iso, console, div, ts = d["iso"], d["console"], d["div"], d["ts"]
    return f"""
SELECT seq, eventID, eventTime, CASE WHEN timeOk THEN ms END AS eventMs,
  CASE WHEN timeOk THEN {ts("ms")} END AS ts,
  eventName, eventSource, awsRegion, sourceIPAddress, userAgent, identityType, identityArn,
  CASE WHEN ownName <> '' THEN ownName ELSE issuerName END AS userName,
  accountId, principalId, roleArn, sessionName, accessKeyId, issuedKeyId, issuedRoleArn, invokedBy,
  sourceIdentity, errorCode, errorMessage, recipientAccountId,
  coalesce(readText IN ('true', '"true"'), false) AS readOnly,
  CASE WHEN manageText = 'false' THEN false ELSE true END AS managementEvent,
  sharedEventID, requestID, expiration, targetRole, u AS userNo, e AS eventNo, k AS amount, copy,
  CASE WHEN recipientAccountId IS NOT NULL
    THEN concat('event:["', recipientAccountId, '","', eventID, '"]')
    ELSE concat('content:', eventID) END AS eventKey,
  concat('{{"eventVersion":"1.08","eventID":"', eventID, '"',
    CASE WHEN eventTime IS NULL THEN '' ELSE concat(',"eventTime":"', eventTime, '"') END,
    ',"eventName":"', eventName, '","eventSource":"', eventSource, '"',
    CASE WHEN awsRegion IS NULL THEN '' ELSE concat(',"awsRegion":"', awsRegion, '"') END,
    ',"sourceIPAddress":"', sourceIPAddress, '","userAgent":"', userAgent, '"',
    ',"userIdentity":{{"type":"', identityType, '"',
    CASE WHEN identityArn IS NULL THEN '' ELSE concat(',"arn":"', identityArn, '"') END,
    ',"accountId":"', accountId, '","principalId":"', principalId, '"',
    CASE WHEN accessKeyId IS NULL THEN '' ELSE concat(',"accessKeyId":"', accessKeyId, '"') END,
    CASE WHEN ownName IS NULL THEN '' ELSE concat(',"userName":"', ownName, '"') END,
    CASE WHEN invokedBy IS NULL THEN '' ELSE concat(',"invokedBy":"', invokedBy, '"') END,
    CASE WHEN storeUser IS NULL THEN '' ELSE concat(',"onBehalfOf":{{"userId":"', storeUser,
      '","identityStoreArn":"', storeArn, '"}}') END,
    CASE WHEN roleArn IS NULL THEN '' ELSE concat(',"sessionContext":{{"attributes":{{"mfaAuthenticated":"',
      CASE WHEN u % 2 = 0 THEN 'true' ELSE 'false' END, '","creationDate":"', {iso("ms - 3600000")},
      '"}},"sessionIssuer":{{"arn":"', roleArn, '","userName":"', issuerName, '"}}',
      CASE WHEN sourceIdentity IS NULL THEN '' ELSE concat(',"sourceIdentity":"', sourceIdentity, '"') END,
      '}}') END, '}}',
    CASE WHEN errorCode IS NULL THEN '' ELSE concat(',"errorCode":"', errorCode, '"') END,
    CASE WHEN errorMessage IS NULL THEN '' ELSE concat(',"errorMessage":"', errorMessage, '"') END,
    CASE WHEN recipientAccountId IS NULL THEN '' ELSE concat(',"recipientAccountId":"', recipientAccountId, '"') END,
    CASE WHEN readText IS NULL THEN '' ELSE concat(',"readOnly":', readText) END,
    CASE WHEN manageText IS NULL THEN '' ELSE concat(',"managementEvent":', manageText) END,
    CASE WHEN sharedEventID IS NULL THEN '' ELSE concat(',"sharedEventID":"', sharedEventID, '"') END,
    CASE WHEN requestID IS NULL THEN '' ELSE concat(',"requestID":"', requestID, '"') END,
    ',"resources":', resourcesText, ',"requestParameters":', paramsText,
    CASE WHEN issuedKeyId IS NULL THEN '' ELSE concat(',"responseElements":{{"credentials":{{"accessKeyId":"', issuedKeyId, '"',
      CASE WHEN expiration IS NULL THEN '' ELSE concat(',"expiration":"', expiration, '"') END, '}}',
      CASE WHEN issuedRoleArn IS NULL THEN '' ELSE concat(',"assumedRoleUser":{{"arn":"', issuedRoleArn, '"}}') END,
      CASE WHEN eventName = 'GetFederationToken' THEN concat(',"federatedUser":{{"arn":"', targetArn, '"}}') ELSE '' END,
      '}}') END,
    CASE WHEN eventName = 'ConsoleLogin' THEN concat(',"additionalEventData":{{"MFAUsed":"',
      CASE WHEN u % 3 = 0 THEN 'No' ELSE 'Yes' END, '"}}') ELSE '' END,
    ',"extra":', props, '}}') AS raw
FROM (
SELECT *,
  CASE WHEN eventSource = 'sts.amazonaws.com' AND t = 'signup' AND eventName LIKE 'AssumeRole%' AND eventName <> 'AssumeRoot'
    THEN CASE WHEN e % 13 = 0 THEN concat(targetArn, '-other') ELSE targetArn END END AS issuedRoleArn,
  CASE WHEN eventName = 'AssumeRole' AND t = 'signup' THEN concat('arn:aws:iam::', vacct, ':role/role-', cast(v % 7 AS string)) END AS targetRole,
  CASE WHEN t = 'signup' THEN concat('ASIA', lpad(cast(v AS string), 8, '0')) END AS issuedKeyId,
  CASE WHEN t = 'signup' THEN CASE
    WHEN e % 40 = 0 THEN NULL WHEN e % 10 = 1 THEN {console("ms + 86400000")}
    WHEN e % 10 = 2 AND e % 3 = 0 THEN 'soon' WHEN e % 10 = 3 AND e % 3 = 0 THEN {iso("ms - 1000")}
    WHEN copy = 1 AND e % 5 = 0 THEN {iso("ms + 43200000")}
    ELSE {iso("ms + 86400000")} END END AS expiration,
  CASE WHEN eventSource = 's3.amazonaws.com' AND e % 8 = 0 THEN concat('[{{"ARN":"arn:aws:s3:::bucket-', cast(k AS string),
      '","type":"AWS::S3::Bucket"}},{{"ARN":"arn:aws:s3:::bucket-', cast(k % 9 AS string), '","weight":', cast(k AS string), '}},7]')
    WHEN eventSource = 's3.amazonaws.com' AND e % 8 = 1 THEN '[]'
    WHEN eventSource = 's3.amazonaws.com' AND e % 8 = 2 THEN '[{{"ARN":"bucket-name-only"}},{{"ARN":null}}]'
    WHEN eventSource = 's3.amazonaws.com' THEN concat('[{{"ARN":"arn:aws:s3:::bucket-', cast(k AS string), '","type":"AWS::S3::Bucket"}}]')
    WHEN eventSource = 'kms.amazonaws.com' THEN '{{"ARN":"arn:aws:kms:us-east-1:000000000001:key/outer"}}'
    ELSE 'null' END AS resourcesText,
  CASE eventSource
    WHEN 's3.amazonaws.com' THEN concat('{{"bucketName":"bucket-', cast(k AS string), '","key":"obj/', cast(e % 100 AS string),
       '","size":90071992547409', cast(91 + e % 6 AS string), '}}')
    WHEN 'secretsmanager.amazonaws.com' THEN concat('{{"secretId":"arn:aws:secretsmanager:us-east-1:', acct, ':secret:s', cast(k AS string), '"}}')
    WHEN 'kms.amazonaws.com' THEN concat('{{"keyId":"arn:aws:kms:us-east-1:', acct, ':key/', cast(k % 10 AS string),
       '","size":"', cast(k AS string), '.50","context":{{"arn":"arn:aws:s3:::nested-only"}}}}')
    WHEN 'sts.amazonaws.com' THEN CASE WHEN eventName = 'AssumeRoot' THEN concat('{{"targetPrincipal":"', vacct, '"}}')
       ELSE concat('{{"roleArn":"arn:aws:iam::', vacct, ':role/role-', cast(v % 7 AS string), '","durationSeconds":', cast(900 * (1 + e % 5) AS string), '}}') END
    WHEN 'ec2.amazonaws.com' THEN CASE WHEN e % 2 = 0 THEN concat('{{"instanceId":"i-', cast(k AS string), '"}}')
       ELSE concat('{{"instancesSet":{{"items":[{{"instanceId":"i-', cast(k AS string), '"}}]}}}}') END
    WHEN 'iam.amazonaws.com' THEN concat('{{"userName":"u', cast(k AS string), '","secretId":', cast(k AS string), '}}')
    WHEN 'cloudtrail.amazonaws.com' THEN concat('{{"name":"trail-', cast(k % 4 AS string), '"}}')
    ELSE 'null' END AS paramsText
FROM (
SELECT *,
  e * 2 + copy + 1 AS seq,
  concat('ev-', cast(e AS string), CASE WHEN copy = 1 THEN '-x' ELSE '' END) AS eventID,
  e % 389 <> 0 AND e % 397 <> 0 AS timeOk,
  CASE WHEN e % 389 = 0 THEN 'unknown' WHEN e % 397 = 0 THEN NULL ELSE {iso("ms")} END AS eventTime,
  CASE eventName WHEN 'GetObject' THEN 's3.amazonaws.com' WHEN 'PutObject' THEN 's3.amazonaws.com' WHEN 'ListBuckets' THEN 's3.amazonaws.com'
    WHEN 'DescribeInstances' THEN 'ec2.amazonaws.com' WHEN 'RunInstances' THEN 'ec2.amazonaws.com'
    WHEN 'GetSecretValue' THEN 'secretsmanager.amazonaws.com' WHEN 'Decrypt' THEN 'kms.amazonaws.com'
    WHEN 'CreateAccessKey' THEN 'iam.amazonaws.com' WHEN 'ConsoleLogin' THEN 'signin.amazonaws.com'
    WHEN 'StopLogging' THEN 'cloudtrail.amazonaws.com' WHEN 'DeleteTrail' THEN 'cloudtrail.amazonaws.com'
    ELSE 'sts.amazonaws.com' END AS eventSource,
  CASE u % 7 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' WHEN 2 THEN 'ap-south-1' WHEN 3 THEN 'us-west-2'
    WHEN 4 THEN 'EU-West-1' WHEN 5 THEN '' END AS awsRegion,
  CASE WHEN u % 10 = 9 THEN 'cloudformation.amazonaws.com'
    WHEN u % 11 = 0 THEN concat('2001:db8:', cast(u % 16 AS string), '::', cast(e % 250 AS string))
    WHEN u % 13 = 0 THEN concat('::ffff:10.0.0.', cast(e % 250 AS string))
    ELSE concat('10.', cast(u % 4 AS string), '.', cast(u % 250 AS string), '.', cast(e % 250 AS string)) END AS sourceIPAddress,
  CASE WHEN e % 6 = 0 THEN concat('aws-cli/2.15.', cast(e % 9 AS string), ' md/command#s3api.put-object md/installer#exe')
    WHEN e % 6 = 1 THEN 'console.amazonaws.com' ELSE 'Boto3/1.34 100%_literal' END AS userAgent,
  CASE WHEN copy = 1 THEN 'AWSAccount' WHEN c IN (0, 1) THEN 'AssumedRole' WHEN c = 2 THEN 'IAMUser' WHEN c = 3 THEN 'FederatedUser'
    WHEN u % 10 = 4 THEN 'Root' ELSE 'AWSService' END AS identityType,
  CASE WHEN copy = 1 THEN NULL WHEN c IN (0, 1) THEN concat('arn:aws:sts::', acct, ':assumed-role/role-', cast(u % 7 AS string), '/sess-', cast(u AS string))
    WHEN c = 2 THEN concat('arn:aws:iam::', acct, ':user/u', cast(u AS string))
    WHEN c = 3 THEN concat('arn:aws:sts::', acct, ':federated-user/f', cast(u AS string))
    WHEN u % 10 = 4 THEN concat('arn:aws:iam::', acct, ':root') END AS identityArn,
  CASE WHEN copy = 1 THEN NULL WHEN c IN (0, 1) THEN '' WHEN c = 2 THEN concat('u', cast(u AS string)) END AS ownName,
  CASE WHEN copy = 0 AND c IN (0, 1) THEN concat('role-', cast(u % 7 AS string)) END AS issuerName,
  acct AS accountId,
  CASE WHEN c IN (0, 1) THEN concat('AROA', cast(u % 7 AS string), ':sess-', cast(u AS string))
    WHEN c = 3 THEN concat(acct, ':f', cast(u AS string)) ELSE concat('AIDA', cast(u AS string)) END AS principalId,
  CASE WHEN c IN (0, 1) THEN concat('sess-', cast(u AS string)) WHEN c = 3 THEN concat('f', cast(u AS string)) ELSE '' END AS sessionName,
  CASE WHEN copy = 0 AND c IN (0, 1) THEN concat('arn:aws:iam::', acct, ':role/role-', cast(u % 7 AS string)) END AS roleArn,
  CASE WHEN copy = 1 THEN NULL WHEN c IN (0, 1, 3) THEN concat('ASIA', lpad(cast(u AS string), 8, '0'))
    WHEN c = 2 OR u % 10 = 4 AND e % 3 <> 0 THEN concat('AKIA', lpad(cast(u AS string), 8, '0'))
    WHEN u % 10 = 9 THEN '' END AS accessKeyId,
  CASE WHEN u % 10 = 9 AND copy = 0 THEN concat('svc-', cast(u % 3 AS string), '.amazonaws.com') END AS invokedBy,
  CASE WHEN c IN (0, 1) AND u % 3 = 0 AND copy = 0 THEN concat('person-', cast(u % 20 AS string)) END AS sourceIdentity,
  CASE WHEN u % 20 = 1 AND copy = 0 THEN concat('usr-', cast(u AS string)) END AS storeUser,
  CASE WHEN u % 20 = 1 AND copy = 0 THEN concat('arn:aws:identitystore::', acct, ':identitystore/d-', cast(u % 3 AS string)) END AS storeArn,
  CASE WHEN t = 'error' THEN CASE e % 4 WHEN 0 THEN 'AccessDenied' WHEN 1 THEN 'Client.UnauthorizedOperation'
    WHEN 2 THEN 'ThrottlingException' ELSE 'AccessDenied' END WHEN e % 2 = 0 THEN NULL ELSE '' END AS errorCode,
  CASE WHEN t = 'error' AND e % 4 = 2 THEN 'Rate exceeded' WHEN e % 53 = 0 THEN 'Partial failure' END AS errorMessage,
  CASE WHEN e % 101 = 0 THEN NULL WHEN copy = 1 THEN lpad(cast((u + 1) % 25 AS string), 12, '0') ELSE acct END AS recipientAccountId,
  CASE WHEN t IN ('view', 'click') THEN 'true' WHEN t IN ('purchase', 'signup') THEN 'false'
    WHEN e % 4 = 0 THEN NULL WHEN e % 4 = 2 THEN '"true"' ELSE 'false' END AS readText,
  CASE WHEN eventName IN ('GetObject', 'PutObject') THEN 'false' END AS manageText,
  CASE WHEN t = 'signup' AND e % 6 = 0 THEN concat('sh-', cast(e AS string))
    WHEN eventName = 'Decrypt' THEN concat('sh-', cast({div("e", 20)} AS string)) END AS sharedEventID,
  CASE WHEN e % 4 <> 0 THEN concat('rq-', cast({div("e", 50)} AS string)) END AS requestID,
  CASE WHEN v % 5 IN (0, 1) THEN concat('arn:aws:sts::', vacct, ':assumed-role/role-', cast(v % 7 AS string), '/sess-', cast(v AS string))
    WHEN v % 5 = 3 THEN concat('arn:aws:sts::', vacct, ':federated-user/f', cast(v AS string)) END AS targetArn
FROM (
SELECT *, u % 5 AS c, lpad(cast(u % 25 AS string), 12, '0') AS acct, lpad(cast(v % 25 AS string), 12, '0') AS vacct,
  CASE t WHEN 'view' THEN CASE e % 3 WHEN 0 THEN 'GetObject' WHEN 1 THEN 'DescribeInstances' ELSE 'ListBuckets' END
    WHEN 'click' THEN CASE e % 2 WHEN 0 THEN 'GetSecretValue' ELSE 'Decrypt' END
    WHEN 'purchase' THEN CASE e % 3 WHEN 0 THEN 'PutObject' WHEN 1 THEN 'RunInstances' ELSE 'CreateAccessKey' END
    WHEN 'signup' THEN CASE WHEN v % 5 = 3 THEN 'GetFederationToken' WHEN v % 5 = 2 THEN 'GetSessionToken'
      WHEN v % 5 = 4 THEN 'AssumeRoot' WHEN e % 9 = 0 THEN 'AssumeRoleWithSAML' ELSE 'AssumeRole' END
    ELSE CASE e % 4 WHEN 0 THEN 'ConsoleLogin' WHEN 1 THEN 'StopLogging' WHEN 2 THEN 'DeleteTrail' ELSE 'AssumeRole' END END AS eventName
FROM (
SELECT e, u, t, props, copy, ms0 - ms0 % {tick_ms} AS ms, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k,
  CASE WHEN e % 23 = 0 THEN u WHEN e % 7 = 0 THEN greatest(u - 2, 0) ELSE u + 1 + e % 4 END AS v
FROM (SELECT event_id AS e, user_id AS u, event_type AS t, props, {d["ms"]} AS ms0, {d["explode"]} AS copy FROM {source}) b0
) b1 ) b2 ) b3 ) b4"""


def project_events(spark: SparkSession, sf_dir: str, tick_ms: int = 1) -> DataFrame:
    """The projection itself, not stored."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), TASK_ROWS)
    source.createOrReplaceTempView("audit_source_events")
    return spark.sql(_text(_SPARK, "audit_source_events", tick_ms))


#: Rows of the source that one task projects and parses.
TASK_ROWS = 20_000

_stored: dict[tuple[str, str, int], str] = {}


def audit_events(spark: SparkSession, sf_dir: str, tick_ms: int = 1) -> DataFrame:
    """Audit events (one row per logical event, all extracted columns + ``raw``).

    Events are imported once per application into a Parquet table in the shared
    checkpoint folder, as the engine stores them: every query then scans only
    its columns and its bounds on stored columns reach the scan.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir, tick_ms)
    if key not in _stored:
        path = f"{shared_folder(spark)}/audit-events-{uuid.uuid4().hex}"
        with_facts(project_events(spark, sf_dir, tick_ms)).write.option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def audit_events_sql(tick_ms: int = 1) -> str:
    """The same rows for DuckDB, to be used as ``WITH ev AS (<this>)``."""
    return _text(_DUCK, "events", tick_ms)
