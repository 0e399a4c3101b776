"""Registered queries: extraction, labels, search, summaries, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, records
from ..model import Filter, Snapshot
from ..operators import aggregates, paging, search, tags
from ..session import small_table
from .common import ACCOUNT_SQL, ASKED_ROLE_SQL, HAS_ERROR_SQL, KEY_CTES, RECORDED_RO_SQL, RESULT_SQL, USER_SQL, ev, with_ev

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


_FACET_EXPR = {"result": RESULT_SQL}


def _facet_sql(where: str) -> str:
    """Every event becomes a list of its fields; the commonest values of a field are the head of an ordered list."""
    cells = ", ".join(f"{{'name': '{n}', 'held': coalesce({_FACET_EXPR.get(n, n)}, '')}}" for n in search.FACET_FIELDS)
    return with_ev(f"""SELECT name AS field, head[place].held AS value, head[place].many AS count, place AS rank, CAST(everything - nothing AS BIGINT) AS present,
  CAST(nothing AS BIGINT) AS missing, given AS distinctValues, given > 25 AS truncated
FROM (SELECT name, sum(many) AS everything, sum(CASE held WHEN '' THEN many ELSE 0 END) AS nothing, sum(CASE held WHEN '' THEN 0 ELSE 1 END) AS given,
    list_slice(list({{'held': held, 'many': many}} ORDER BY length(held) = 0, many DESC, held), 1, 25) AS head FROM tally GROUP BY name) AS folded
  JOIN generate_series(1, 25) AS places(place) ON place <= len(head) WHERE given = 0 OR length(head[place].held) > 0""", ctes=f"""
tally AS (SELECT cell.name AS name, cell.held AS held, count(*) AS many FROM (SELECT unnest([{cells}]) AS cell FROM ev WHERE {where}) AS spread GROUP BY ALL)""")


FLAGSHIP_FILTER = Filter(excludes={"eventName": ["DescribeInstances"]}, exists=["sourceIPAddress"],
                         from_ms=1704153600000, to_ms=1706572800000)
_FLAGSHIP_WHERE = ("coalesce(eventName, '') <> 'DescribeInstances' AND coalesce(sourceIPAddress, '') <> '' "
                   "AND eventMs BETWEEN 1704153600000 AND 1706572800000")


@_register("search_facets_filtered", _facet_sql(_FLAGSHIP_WHERE))
def search_facets_filtered(spark, sf):
    return aggregates.facets(ev(spark, sf), FLAGSHIP_FILTER)


@_register("search_facets_all", _facet_sql("true"))
def search_facets_all(spark, sf):
    return aggregates.facets(ev(spark, sf))


@_register("extract_event_columns", with_ev(f"SELECT seq, {', '.join(c for c in records.EVENT_COLUMNS if c != 'ts')} FROM ev"))
def extract_event_columns(spark, sf):
    return records.extract_events(ev(spark, sf).select("seq", "raw")).drop("raw", "ts")


_TARGET_SQL = f"""CASE split_part(eventSource, '.', 1) WHEN 's3' THEN 'bucket-' || amount || '/obj/' || eventNo % 100
  WHEN 'secretsmanager' THEN 'arn:aws:secretsmanager:us-east-1:' || {ACCOUNT_SQL} || ':secret:s' || amount
  WHEN 'kms' THEN 'arn:aws:kms:us-east-1:' || {ACCOUNT_SQL} || ':key/' || amount % 10 WHEN 'ec2' THEN 'i-' || amount
  WHEN 'sts' THEN CASE WHEN eventName <> 'AssumeRoot' THEN {ASKED_ROLE_SQL} ELSE '' END ELSE '' END"""
_ACTED_SQL = f"""CASE split_part(eventSource, '.', 1) WHEN 's3' THEN CASE eventNo % 8 WHEN 1 THEN 'bucket-' || amount WHEN 2 THEN 'bucket-name-only'
    ELSE 'arn:aws:s3:::bucket-' || amount END
  WHEN 'ec2' THEN CASE WHEN eventNo % 2 = 0 THEN 'i-' || amount ELSE '' END WHEN 'iam' THEN CAST(amount AS VARCHAR)
  WHEN 'cloudtrail' THEN 'trail-' || amount % 4 ELSE {_TARGET_SQL} END"""


@_register("display_labels", with_ev(f"""SELECT seq, {USER_SQL} AS userLabel, {RESULT_SQL} AS resultLabel, {HAS_ERROR_SQL} AS hasError,
  {RECORDED_RO_SQL} AS recordedReadOnly, {_TARGET_SQL} AS target, {_ACTED_SQL} AS actedOn FROM ev"""))
def display_labels(spark, sf):
    return labels.with_target(ev(spark, sf)).select(
        "seq", labels.user_label().alias("userLabel"), labels.result_label().alias("resultLabel"),
        records.has_error().alias("hasError"), F.col("facts.recordedReadOnly").alias("recordedReadOnly"),
        "target", labels.acted_on().alias("actedOn"))


@_register("event_presentation", with_ev("""SELECT seq,
  CASE WHEN identityType = 'AssumedRole' THEN split_part(split_part(identityArn, ':assumed-role/', 2), '/', 1)
    WHEN identityType = 'Root' THEN 'Root' WHEN userName IS NOT NULL THEN userName
    ELSE coalesce(identityArn, principalId) END AS actorName,
  coalesce(sessionName, '') AS actorSession,
  CASE identityType WHEN 'AssumedRole' THEN 'Assumed role' WHEN 'IAMUser' THEN 'IAM user' WHEN 'AWSService' THEN 'AWS service'
    WHEN 'AWSAccount' THEN 'AWS account' WHEN 'FederatedUser' THEN 'Federated user' ELSE identityType END AS actorType,
  CASE split_part(eventSource, '.', 1) WHEN 's3' THEN 'S3' WHEN 'ec2' THEN 'EC2' WHEN 'secretsmanager' THEN 'Secrets Manager'
    WHEN 'kms' THEN 'KMS' WHEN 'iam' THEN 'IAM' WHEN 'signin' THEN 'AWS sign-in' WHEN 'cloudtrail' THEN 'CloudTrail' ELSE 'STS' END AS serviceLabel,
  CASE eventName WHEN 'GetObject' THEN 'Object read' WHEN 'PutObject' THEN 'Object write' WHEN 'ListBuckets' THEN 'Bucket listing'
    WHEN 'DescribeInstances' THEN 'Instance listing' WHEN 'RunInstances' THEN 'Instance launch' WHEN 'GetSecretValue' THEN 'Secret read'
    WHEN 'Decrypt' THEN 'Decryption' WHEN 'CreateAccessKey' THEN 'Access key creation' WHEN 'StopLogging' THEN 'Trail logging stop'
    WHEN 'AssumeRole' THEN 'Role assumption' WHEN 'AssumeRoleWithSAML' THEN 'SAML role assumption' ELSE eventName END ||
  CASE WHEN errorCode IN ('AccessDenied', 'Client.UnauthorizedOperation') THEN ' denied'
    WHEN coalesce(errorCode, '') <> '' OR coalesce(errorMessage, '') <> '' THEN ' reported an error'
    WHEN eventName IN ('DeleteTrail', 'ConsoleLogin', 'GetSessionToken', 'GetFederationToken', 'AssumeRoot') THEN ' recorded'
    ELSE ' requested' END AS headline,
  CASE WHEN coalesce(errorCode, '') <> '' THEN errorCode WHEN coalesce(errorMessage, '') <> '' THEN 'Error recorded' ELSE 'No error recorded' END AS outcome,
  CASE WHEN coalesce(errorCode, '') <> '' OR coalesce(errorMessage, '') <> '' THEN 'error' ELSE 'neutral' END AS tone,
  CASE WHEN userAgent LIKE 'aws-cli%' THEN 'aws s3api put-object' ELSE '' END AS cliCommand
FROM ev"""))
def event_presentation(spark, sf):
    return labels.present_events(ev(spark, sf)).select(
        "seq", "actorName", "actorSession", "actorType", "serviceLabel", "headline", "outcome", "tone",
        labels.cli_command().alias("cliCommand"))


@_register("identity_facts", with_ev("""SELECT DISTINCT coalesce(identityType, '') AS identityType, coalesce(identityArn, '') AS identityArn,
  coalesce(roleArn, '') AS roleArn, coalesce(split_part(roleArn, '/', 2), '') AS roleName,
  CASE WHEN identityType = 'AWSService' THEN 'service' ELSE '' END AS originKind,
  CASE WHEN identityArn LIKE '%:assumed-role/%' THEN split_part(identityArn, ':', 5) ELSE '' END AS stsAccount,
  CASE WHEN identityArn LIKE '%:assumed-role/%' THEN split_part(identityArn, '/', 2) ELSE '' END AS stsRole,
  CASE WHEN identityArn LIKE '%:assumed-role/%' THEN split_part(identityArn, '/', 3) ELSE '' END AS stsSession,
  coalesce(identityType IN ('AssumedRole', 'FederatedUser'), false) OR coalesce(accessKeyId, '') LIKE 'ASIA%' AS temporary,
  NOT (coalesce(identityType IN ('AssumedRole', 'FederatedUser'), false) OR coalesce(accessKeyId, '') LIKE 'ASIA%') AND
    CASE WHEN identityType IN ('IAMUser', 'Root') THEN coalesce(identityArn, '') <> '' AND coalesce(accessKeyId, '') LIKE 'AKIA%'
    WHEN identityType = 'AWSService' THEN coalesce(invokedBy, '') <> '' OR coalesce(identityArn, '') <> '' ELSE false END AS terminal
FROM ev"""))
def identity_facts(spark, sf):
    account, role, session = labels.sts_parts(F.col("identityArn"))
    blank = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return ev(spark, sf).select(
        blank("identityType"), blank("identityArn"), blank("roleArn"), labels.role_name(F.col("roleArn")).alias("roleName"),
        labels.origin_kind(F.col("identityType"), F.col("roleArn")).alias("originKind"), account.alias("stsAccount"),
        role.alias("stsRole"), session.alias("stsSession"), labels.is_temporary().alias("temporary"),
        labels.is_terminal().alias("terminal")).distinct()


# --- predicates: one matrix query evaluates every case over the whole table ---
_PREDICATES = {
    "eq_case": ({"t": "cmp", "field": "EVENTNAME", "op": "eq", "value": "getobject"}, "lower(coalesce(eventName,'')) = 'getobject'"),
    "ne": ({"t": "cmp", "field": "awsRegion", "op": "ne", "value": "eu-west-1"}, "lower(coalesce(awsRegion,'')) <> 'eu-west-1'"),
    "glob": ({"t": "cmp", "field": "eventName", "op": "eq", "value": "get*"}, "coalesce(eventName,'') ILIKE 'get%'"),
    "glob_one": ({"t": "cmp", "field": "user", "op": "eq", "value": "u?2"}, f"{USER_SQL} ILIKE 'u_2'"),
    "glob_ne": ({"t": "cmp", "field": "userAgent", "op": "ne", "value": "*100%_l*"}, "NOT coalesce(userAgent,'') ILIKE '%100\\%\\_l%' ESCAPE '\\'"),
    "star": ({"t": "cmp", "field": "errorCode", "op": "eq", "value": "*"}, "coalesce(errorCode,'') <> ''"),
    "star_ne": ({"t": "cmp", "field": "roleArn", "op": "ne", "value": "*"}, "coalesce(roleArn,'') = ''"),
    "exists": ({"t": "cmp", "field": "identityArn", "op": "exists"}, "coalesce(identityArn,'') <> ''"),
    "nexists": ({"t": "cmp", "field": "awsRegion", "op": "nexists"}, "coalesce(awsRegion,'') = ''"),
    "contains": ({"t": "cmp", "field": "userAgent", "op": "contains", "value": "100%_LIT"}, "contains(lower(coalesce(userAgent,'')), '100%_lit')"),
    "regex": ({"t": "cmp", "field": "sourceIPAddress", "op": "regex", "value": r"^10\.[0-1]\.\d+\.(1|2)\d$"},
              r"regexp_matches(coalesce(sourceIPAddress,''), '^10\.[0-1]\.\d+\.(1|2)\d$', 'i')"),
    "nregex": ({"t": "cmp", "field": "eventSource", "op": "nregex", "value": "^(S3|ec2)"}, "NOT regexp_matches(coalesce(eventSource,''), '^(S3|ec2)', 'i')"),
    "result": ({"t": "cmp", "field": "result", "op": "eq", "value": "success"}, f"lower({RESULT_SQL}) = 'success'"),
    "boolean": ({"t": "cmp", "field": "readOnly", "op": "eq", "value": "TRUE"}, "readOnly"),
    "text": ({"t": "text", "value": "SESS-1"}, None),
    "text_regex": ({"t": "text", "value": "denied$|^u1\\d+$", "regex": True}, None),
    "tree": ({"t": "and", "nodes": [
        {"t": "or", "nodes": [{"t": "cmp", "field": "eventName", "op": "eq", "value": "PutObject"},
                              {"t": "cmp", "field": "eventSource", "op": "contains", "value": "sts"}]},
        {"t": "not", "node": {"t": "cmp", "field": "awsRegion", "op": "eq", "value": "us-*"}}]},
        "(eventName = 'PutObject' OR contains(eventSource, 'sts')) AND NOT coalesce(awsRegion,'') ILIKE 'us-%'"),
}
_TEXT_SQL = [{"user": USER_SQL, "result": RESULT_SQL, "readOnly": "CAST(readOnly AS VARCHAR)",
              "managementEvent": "CAST(managementEvent AS VARCHAR)"}.get(n, n) for n in search.TEXT_FIELDS]


def _predicate_sql(name: str) -> str:
    sql = _PREDICATES[name][1]
    if name == "text":
        sql = " OR ".join(f"contains(lower(coalesce({c}, '')), 'sess-1')" for c in _TEXT_SQL)
    if name == "text_regex":
        sql = " OR ".join(f"regexp_matches(coalesce({c}, ''), 'denied$|^u1\\d+$', 'i')" for c in _TEXT_SQL)
    return sql


@_register("predicate_matrix", with_ev("SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {_predicate_sql(n)}) AS {n}_n, CAST(sum(CASE WHEN {_predicate_sql(n)} THEN seq ELSE 0 END) AS BIGINT) AS {n}_sum"
    for n in _PREDICATES) + " FROM ev"))
def predicate_matrix(spark, sf):
    hits = ev(spark, sf).select("seq", *[search.expr_column(tree).alias(n) for n, (tree, _) in _PREDICATES.items()])
    return hits.agg(*[agg for n in _PREDICATES for agg in (
        F.count_if(n).alias(f"{n}_n"), F.sum(F.when(F.col(n), F.col("seq")).otherwise(0)).alias(f"{n}_sum"))])


@_register("filter_rows", with_ev("""SELECT seq, eventID FROM ev WHERE lower(coalesce(eventName, '')) IN ('getobject', 'assumerole')
  AND lower(coalesce(awsRegion, '')) NOT IN ('us-east-1', '') AND coalesce(identityArn, '') <> '' AND NOT readOnly
  AND eventMs BETWEEN 1704100000000 AND 1706000000000 AND coalesce(userAgent, '') ILIKE '%boto3%'"""))
def filter_rows(spark, sf):
    f = Filter(includes={"eventName": ["GETOBJECT", "AssumeRole"]}, excludes={"awsRegion": ["us-east-1", ""]},
               exists=["identityArn"], hide_read_only=True, from_ms=1704100000000, to_ms=1706000000000,
               expr={"t": "cmp", "field": "userAgent", "op": "contains", "value": "BOTO3"})
    return search.apply_filter(ev(spark, sf), f).select("seq", "eventID")


@_register("filter_errors_only", with_ev("SELECT seq, errorCode FROM ev WHERE coalesce(errorCode, '') <> '' AND contains(lower(eventName), 'trail')"))
def filter_errors_only(spark, sf):
    f = Filter(errors_only=True, expr={"t": "cmp", "field": "eventName", "op": "contains", "value": "Trail"})
    return search.apply_filter(ev(spark, sf), f).select("seq", "errorCode")


@_register("search_stats", with_ev("""SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(errorCode, '') <> '') AS errors,
  count(DISTINCT coalesce(nullif(identityArn, ''), nullif(userName, ''), nullif(principalId, ''))) AS principals,
  count(DISTINCT nullif(eventSource, '')) AS sources, count(DISTINCT nullif(awsRegion, '')) AS regions,
  coalesce(min(eventMs), 0) AS minMs, coalesce(max(eventMs), 0) AS maxMs FROM ev"""))
def search_stats(spark, sf):
    return aggregates.stats(ev(spark, sf))


@_register("search_histogram", with_ev("""SELECT epoch_ms(time_bucket(to_seconds(step), ts)) AS t, step * 1000 AS step, count(*) AS n,
  count(*) FILTER (WHERE coalesce(errorCode, '') <> '') AS e
FROM ev, (SELECT greatest(60, (max(eventMs) - min(eventMs)) // 1000 // 120) AS step FROM ev) s
WHERE ts IS NOT NULL GROUP BY 1, 2"""))
def search_histogram(spark, sf):
    return aggregates.histogram(ev(spark, sf))


@_register("dense_histogram", with_ev("""SELECT g.start AS start, g.start + 3600000 AS "end", CAST(3600000 AS BIGINT) AS step, count(e.seq) AS total,
  count(e.seq) FILTER (WHERE coalesce(errorCode, '') <> '') AS errors
FROM (SELECT unnest(generate_series(lo // 3600000 * 3600000, 1706745600000 - 3600000, 3600000)) AS start
      FROM (SELECT min(eventMs) AS lo FROM ev WHERE eventName = 'RunInstances')) g
LEFT JOIN (SELECT * FROM ev WHERE eventName = 'RunInstances') e ON e.eventMs // 3600000 * 3600000 = g.start GROUP BY 1"""))
def dense_histogram(spark, sf):
    return aggregates.dense_histogram(ev(spark, sf), 1706745600000, Filter(includes={"eventName": ["RunInstances"]}))


def _activity_sql(group: str = "") -> str:
    return f"""count(*) AS events, count(*) FILTER (WHERE {HAS_ERROR_SQL}) AS errors,
  count(*) FILTER (WHERE {RECORDED_RO_SQL} IS FALSE) AS writes, count(*) FILTER (WHERE {RECORDED_RO_SQL} IS NULL) AS unknownReadOnly,
  count(DISTINCT nullif(accessKeyId, '')) AS credentialIDs, count(*) FILTER (WHERE eventMs IS NULL) AS invalidTimes,
  min(eventMs) AS firstMs, max(eventMs) AS lastMs"""


@_register("activity_stats", with_ev(f"SELECT {_activity_sql()} FROM ev"))
def activity_stats(spark, sf):
    return aggregates.activity_stats(ev(spark, sf))


_WINDOWS = """win AS (SELECT *, eventMs >= stop - {h} AND eventMs < stop AS inCurrent,
  eventMs >= stop - 2 * {h} AND eventMs < stop - {h} AS inPrevious
  FROM ev, (SELECT max(eventMs) + 1 AS stop FROM ev) m)"""


@_register("window_stats", with_ev(f"""SELECT CASE WHEN inCurrent THEN 'current' ELSE 'previous' END AS period, {_activity_sql()}
FROM win WHERE inCurrent OR inPrevious GROUP BY 1""", ctes=_WINDOWS.format(h=604800000)))
def window_stats(spark, sf):
    return aggregates.window_stats(ev(spark, sf), 168)


_COMPARE_BRANCHES = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, coalesce({d}, '') AS value, count(*) FILTER (WHERE inCurrent) AS current,
  count(*) FILTER (WHERE inPrevious) AS previous, count(*) FILTER (WHERE inCurrent AND {HAS_ERROR_SQL}) AS errors,
  count(*) FILTER (WHERE inCurrent AND {RECORDED_RO_SQL} IS FALSE) AS writes FROM win WHERE inCurrent OR inPrevious GROUP BY 1, 2"""
    for d in aggregates.DIMENSIONS)


@_register("compare_periods", with_ev(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension
  ORDER BY abs(current - previous) DESC, current DESC, value) AS rank, count(*) OVER (PARTITION BY dimension) AS totalGroups
FROM ({_COMPARE_BRANCHES})) WHERE rank <= 50""", ctes=_WINDOWS.format(h=86400000)))
def compare_periods(spark, sf):
    return aggregates.compare_windows(ev(spark, sf), 24)


@_register("entity_breakdown", with_ev("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY current DESC, value) AS rank, count(*) OVER (PARTITION BY dimension) AS totalGroups FROM ("
  + " UNION ALL ".join(f"""SELECT '{d}' AS dimension, coalesce({d}, '') AS value, count(*) AS current, CAST(0 AS BIGINT) AS previous,
  count(*) FILTER (WHERE {HAS_ERROR_SQL}) AS errors, count(*) FILTER (WHERE {RECORDED_RO_SQL} IS FALSE) AS writes
  FROM ev WHERE coalesce(awsRegion, '') = 'eu-west-1' GROUP BY 1, 2""" for d in ("eventSource", "eventName", "sourceIPAddress"))
  + ")) WHERE rank <= 10"))
def entity_breakdown(spark, sf):
    return aggregates.entity_breakdown(ev(spark, sf), ("awsRegion", "eu-west-1"))


@_register("entity_latest", with_ev("SELECT seq, eventMs, eventName FROM ev WHERE coalesce(awsRegion, '') = 'EU-West-1' ORDER BY eventMs DESC NULLS LAST, seq DESC LIMIT 25"))
def entity_latest(spark, sf):
    return aggregates.entity_latest(ev(spark, sf), ("awsRegion", "EU-West-1")).select("seq", "eventMs", "eventName")


@_register("group_threshold_rows", with_ev("""SELECT seq, userNo FROM ev WHERE errorCode = 'AccessDenied' AND identityArn IN
  (SELECT identityArn FROM ev WHERE errorCode = 'AccessDenied' GROUP BY 1 HAVING count(DISTINCT eventName) >= 2)"""))
def group_threshold_rows(spark, sf):
    denied = ev(spark, sf).filter(F.col("errorCode") == "AccessDenied")
    return aggregates.group_threshold(denied, lambda n: n >= 2, F.col("identityArn"), F.col("eventName")).select("seq", "userNo")


@_register("group_threshold_global", with_ev("""SELECT seq FROM ev WHERE eventName = 'StopLogging'
  AND (SELECT count(*) FROM ev WHERE eventName = 'StopLogging') > 10"""))
def group_threshold_global(spark, sf):
    rows = ev(spark, sf).filter(F.col("eventName") == "StopLogging")
    return aggregates.group_threshold(rows, lambda n: n > 10).select("seq")


_ISSUE = """eventSource = 'sts.amazonaws.com' AND eventName IN ('AssumeRole','AssumeRoleWithSAML','AssumeRoleWithWebIdentity','AssumeRoot','GetSessionToken','GetFederationToken')
  AND coalesce(errorCode,'') = '' AND coalesce(errorMessage,'') = '' AND coalesce(issuedKeyId,'') <> ''"""


@_register("key_activity", with_ev(f"""SELECT accessKeyId, count(*) AS events,
  count(DISTINCT issuedKeyId) FILTER (WHERE {_ISSUE} AND issuedKeyId <> accessKeyId) AS issuedKeys
FROM ev WHERE coalesce(accessKeyId, '') <> '' GROUP BY 1"""))
def key_activity(spark, sf):
    return aggregates.key_activity(ev(spark, sf))


@_register("role_activity", with_ev("SELECT roleArn, count(*) AS events, count(DISTINCT accessKeyId) AS sessions FROM ev WHERE coalesce(roleArn, '') <> '' GROUP BY 1"))
def role_activity(spark, sf):
    return aggregates.role_activity(ev(spark, sf))


@_register("key_identities", with_ev("""SELECT speaker.accessKeyId, speaker.seq, variants, speaker.identityType, speaker.identityArn, speaker.roleArn, speaker.userName,
  speaker.sessionName, speaker.accountId, speaker.invokedBy, variants > 1 AS conflict
FROM ev AS speaker JOIN first_rows ON first_rows.seq = speaker.seq JOIN spellings ON spellings.accessKeyId = speaker.accessKeyId""", ctes=KEY_CTES))
def key_identities(spark, sf):
    return aggregates.key_identities(ev(spark, sf), variants=True)


@_register("hunt_scope", with_ev("""SELECT count(*) AS scanned, count(*) FILTER (WHERE eventMs IS NULL) AS invalidTimes,
  count(*) FILTER (WHERE coalesce(identityArn, '') = '') AS missingPrincipal, count(*) FILTER (WHERE coalesce(accessKeyId, '') = '') AS missingCredential FROM ev"""))
def hunt_scope(spark, sf):
    return aggregates.hunt_scope(ev(spark, sf))


_PAGE_COLS = ", ".join(records.PAGE_COLUMNS)


@_register("page_newest", with_ev(f"SELECT {_PAGE_COLS} FROM ev WHERE coalesce(errorCode, '') <> '' ORDER BY seq DESC LIMIT 200 OFFSET 200"))
def page_newest(spark, sf):
    return paging.page(ev(spark, sf), Filter(errors_only=True), 200, 200).select(*records.PAGE_COLUMNS)


def _three_quarters(spark, sf) -> Snapshot:
    """A snapshot that holds three quarters of the numbers."""
    return Snapshot("g1", ev(spark, sf).agg(F.max("seq")).first()[0] * 3 // 4)


_SNAPSHOT_SQL = "seq <= (SELECT max(seq) * 3 // 4 FROM ev)"


@_register("page_keyset", with_ev(f"SELECT seq, eventID, eventTime FROM ev WHERE {_SNAPSHOT_SQL} AND seq < (SELECT max(seq) // 2 FROM ev) ORDER BY seq DESC LIMIT 5000"))
def page_keyset(spark, sf):
    events = ev(spark, sf)
    half = events.agg(F.max("seq")).first()[0] // 2
    return paging.page_before(events, None, _three_quarters(spark, sf), half, 5000).select("seq", "eventID", "eventTime")


@_register("page_tail", with_ev("SELECT seq, eventName FROM (SELECT * FROM ev WHERE seq > 700 AND readOnly = false ORDER BY seq LIMIT 500) ORDER BY seq DESC"))
def page_tail(spark, sf):
    return paging.newer(ev(spark, sf), Filter(hide_read_only=True), 700).select("seq", "eventName")


@_register("snapshot_stats", with_ev("SELECT count(*) AS total, coalesce(max(eventMs), 0) AS maxMs FROM ev WHERE " + _SNAPSHOT_SQL + " AND contains(lower(coalesce(sourceIPAddress, '')), '2001:db8')"))
def snapshot_stats(spark, sf):
    f = Filter(expr={"t": "cmp", "field": "sourceIPAddress", "op": "contains", "value": "2001:DB8"})
    return paging.search(ev(spark, sf), f, _three_quarters(spark, sf))["stats"].select("total", "maxMs")


# --- tags: a catalog and labels derived from the tables -----------------------
_CATALOG = [("GetSecretValue", "secretsmanager", "credential-access", "high", True, "Reads a stored secret."),
            ("StopLogging", "cloudtrail", "defense-evasion", "high", True, "Stops the audit trail."),
            ("DeleteTrail", "cloudtrail", "defense-evasion", "high", True, "Removes the audit trail."),
            ("CreateAccessKey", "iam", "persistence", "medium", False, "Adds a long-lived key."),
            ("ListBuckets", "s3", "discovery", "low", False, "Lists storage.")]


@_register("sensitive_tags", with_ev("""SELECT seq, eventName, lower(eventName) IN ('getsecretvalue', 'stoplogging', 'deletetrail', 'runinstances') AS sensitive,
  coalesce(severity, '') AS severity, coalesce(category, '') AS category
FROM ev LEFT JOIN (VALUES """ + ", ".join(f"('{n.lower()}', '{sev}', '{cat}')" for n, _, cat, sev, _, _ in _CATALOG)
  + ") c(k, severity, category) ON lower(ev.eventName) = c.k"))
def sensitive_tags(spark, sf):
    catalog = small_table(spark, _CATALOG, tags.CATALOG_SCHEMA)
    return tags.tag_sensitive(ev(spark, sf), catalog, add=["runinstances"], remove=["CreateAccessKey"]).select(
        "seq", "eventName", "sensitive", F.coalesce("severity", F.lit("")).alias("severity"),
        F.coalesce("category", F.lit("")).alias("category"))


@_register("sensitive_filter", with_ev("SELECT seq FROM ev WHERE lower(eventName) IN ('getsecretvalue', 'deletetrail')"))
def sensitive_filter(spark, sf):
    catalog = small_table(spark, _CATALOG, tags.CATALOG_SCHEMA)
    return tags.sensitive_only(ev(spark, sf), catalog, chosen=["GetSecretValue", "DeleteTrail", "GetObject"]).select("seq")


# Roles that the fixture lacks: reserved single-sign-on roles and service-linked ones, by the user's number.
_SPECIAL_ARN = """CASE userNo % 3 WHEN 0 THEN concat('arn:aws:iam::', accountId, ':role/aws-reserved/sso.amazonaws.com/eu-west-1/AWSReservedSSO_Team_', CAST(userNo % 7 AS {0}), '_abc123')
  WHEN 1 THEN concat('arn:aws:iam::', accountId, ':role/aws-service-role/x.amazonaws.com/AWSServiceRoleForX', CAST(userNo % 4 AS {0})) ELSE roleArn END"""


@_register("special_roles", with_ev(f"""SELECT seq, {_SPECIAL_ARN.format('VARCHAR')} AS arn, CASE WHEN userNo % 3 = 0 THEN 'Team_' || userNo % 7 ELSE '' END AS permissionSet,
  CASE userNo % 3 WHEN 0 THEN 'Team_' || userNo % 7 WHEN 1 THEN 'AWSServiceRoleForX' || userNo % 4 ELSE coalesce('role-' || CASE WHEN roleArn <> '' THEN userNo % 7 END, '') END AS roleName,
  CASE WHEN userNo % 3 = 0 THEN 'sso' WHEN userNo % 3 = 1 THEN 'service-linked' WHEN identityType = 'AWSService' THEN 'service' ELSE '' END AS originKind FROM ev"""))
def special_roles(spark, sf):
    arn = F.expr(_SPECIAL_ARN.format("string"))
    return ev(spark, sf).select("seq", arn.alias("arn"), labels.permission_set(arn).alias("permissionSet"), labels.role_name(arn).alias("roleName"),
                                labels.origin_kind(F.col("identityType"), arn).alias("originKind"))


_SEVERITY = {"high": ("StopLogging", "DeleteTrail", "CreateAccessKey", "GetSecretValue"), "low": ("AssumeRole", "GetSessionToken", "GetFederationToken", "AssumeRoot", "RunInstances", "ConsoleLogin")}


@_register("shipped_catalog", with_ev("SELECT eventName, coalesce(severity, '') AS severity, coalesce(severity = 'high', false) AS sensitive, count(*) AS events FROM ev LEFT JOIN (VALUES "
  + ", ".join(f"('{n}', '{s}')" for s, names in _SEVERITY.items() for n in names) + ") c(name, severity) ON name = eventName GROUP BY ALL"))
def shipped_catalog(spark, sf):
    tagged = tags.tag_sensitive(ev(spark, sf), tags.default_catalog(spark))
    return tagged.groupBy("eventName", F.coalesce("severity", F.lit("")).alias("severity"), "sensitive").agg(F.count(F.lit(1)).alias("events"))


@_register("label_annotation", with_ev("""SELECT seq, accountId, label FROM ev JOIN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS value,
  n_name || '/' || r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey) l ON l.value = ev.accountId"""))
def label_annotation(spark, sf):
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lit("account").alias("kind"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0").alias("value"),
        F.concat_ws("/", "n_name", "r_name").alias("label"))
    return tags.annotate(ev(spark, sf), names, "account", "accountId").filter(F.col("label").isNotNull()) \
        .select("seq", "accountId", "label")


@_register("url_globs", """SELECT page_id, url FROM pages WHERE url ILIKE 'http%://%.example.___/%' AND NOT regexp_matches(url, '/\\d+(\\?|$)', 'i')""")
def url_globs(spark, sf):
    from ..functions.text import glob_to_like, java_regex
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.filter(F.col("url").ilike(glob_to_like("http*://*.example.???/*")) & ~F.col("url").rlike(java_regex(r"/\d+(\?|$)"))) \
        .select("page_id", "url")
