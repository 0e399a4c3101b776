"""Registered queries: detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .common import ev, with_ev

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


_AWS = {"product": "aws", "service": "cloudtrail"}
_EXAMPLE_SQL = {
    "Credentials asked for over an hour": "eventSource LIKE 'sts.%' AND eventName <> 'AssumeRoot' AND eventNo % 5 = 4",
    "Role session hands out a permanent key": "eventName = 'CreateAccessKey' AND userNo % 5 < 2 AND copy = 0",
    "Storage written by an unattended client": "eventName = 'PutObject' AND eventNo % 6 <> 1",
    "Machines started in an unusual region": "eventName = 'RunInstances' AND coalesce(awsRegion, '?') NOT IN ('us-east-1', 'eu-west-1', 'EU-West-1', '')",
    "Calls that were slowed down or refused": "errorCode <> ''",
    "Sign-in from outside the office": "eventName = 'ConsoleLogin' AND (sourceIPAddress LIKE '10.1.%' OR sourceIPAddress LIKE '10.3.%' OR sourceIPAddress LIKE '2001:db8:%')",
}
# One rule per modifier family, each with its hand-written predicate.
_MODIFIER_RULES = [
    ("contains and keywords", {"a": {"userAgent|contains": "BOTO"}, "k": ["bucket-1?\"", "nothing*here"], "condition": "a and k"},
     "userAgent ILIKE '%boto%' AND regexp_matches(raw, 'bucket-1.\"')"),
    ("starts and ends", {"a": {"eventName|startswith": "get", "eventSource|endswith": ".AMAZONAWS.com"}, "condition": "a"}, "eventName LIKE 'Get%'"),
    ("cased", {"a": {"awsRegion|cased": "eu-west-1"}, "b": {"awsRegion": "eu-west-1"}, "condition": "b and not a"}, "awsRegion = 'EU-West-1'"),
    ("all values", {"a": {"userAgent|contains|all": ["aws", "md/"]}, "condition": "a"}, "userAgent LIKE 'aws-cli%'"),
    ("wildcards", {"a": {"requestParameters.bucketName": "bucket-?", "eventName": ["*Object"]}, "condition": "all of them"},
     "eventName LIKE '%Object' AND length(json_extract_string(raw, '$.requestParameters.bucketName')) = 8"),
    ("exists", {"a": {"additionalEventData.MFAUsed|exists": True}, "b": {"resources|exists": False}, "c": {"requestParameters|exists": True}, "condition": "(a or b) and c"},
     "eventName = 'ConsoleLogin'"),
    ("null values", {"a": {"recipientAccountId": None}, "b": {"userIdentity.arn": None}, "condition": "1 of them"}, "recipientAccountId IS NULL OR identityArn IS NULL"),
    ("array any", {"a": {"resources.ARN|endswith": ["-7", "-8"]}, "condition": "a"},
     "json_type(raw, '$.resources') = 'ARRAY' AND regexp_matches(CAST(json_extract(raw, '$.resources') AS VARCHAR), '\"ARN\":\"[^\"]*-(7|8)\"')"),
    ("array null", {"a": {"resources.ARN": None}, "b": {"eventSource": "s3.amazonaws.com"}, "condition": "b and a"},
     "eventSource = 's3.amazonaws.com' AND json_array_length(raw, '$.resources') = 0"),
    ("regex cased", {"a": {"errorCode|re": "^(Access|Client)"}, "condition": "a"}, "errorCode LIKE 'Access%' OR errorCode LIKE 'Client%'"),
    ("numbers", {"a": {"requestParameters.durationSeconds|gte": 2700}, "b": {"requestParameters.size": 9007199254740993}, "condition": "a or b"},
     "CAST(json_extract_string(raw, '$.requestParameters.durationSeconds') AS BIGINT) >= 2700 OR json_extract_string(raw, '$.requestParameters.size') = '9007199254740993'"),
    ("cidr", {"a": {"sourceIPAddress|cidr": "10.2.0.0/17"}, "condition": "a"}, "sourceIPAddress LIKE '10.2.%' AND try_cast(split_part(sourceIPAddress, '.', 3) AS INT) < 128"),
    ("missing under not", {"a": {"errorMessage|contains": "rate"}, "b": {"eventName": "DeleteTrail"}, "condition": "b and not a"},
     "eventName = 'DeleteTrail' AND NOT coalesce(errorMessage ILIKE '%rate%', false)"),
    # base64 of the values is "Inst" and "clou", which names of the fixture contain
    ("encoded", {"a": {"eventName|base64|contains": "\"{-"}, "b": {"eventName|wide|base64": "x"}, "condition": "a and not b"}, "eventName LIKE '%Inst%'"),
    ("encoded at any offset", {"a": {"eventSource|base64offset|contains": "rZ."}, "condition": "a"}, "eventSource = 'cloudtrail.amazonaws.com'"),
    ("sign-in without second factor", {"a": {"eventName": "ConsoleLogin", "additionalEventData.MFAUsed|cased": "No"}, "condition": "a"},
     "eventName = 'ConsoleLogin' AND userNo % 3 = 0"),
]
_COUNT_RULES = [
    ("many denials per principal", {"d": {"errorCode": "AccessDenied"}, "condition": "d | count() by userIdentity.arn >= 8"},
     """errorCode = 'AccessDenied' AND identityArn IN (SELECT identityArn FROM ev WHERE errorCode = 'AccessDenied' GROUP BY 1 HAVING count(*) >= 8)"""),
    ("many operations per address", {"d": {"eventSource": "s3.*"}, "condition": "d | count(eventName) by sourceIPAddress > 1"},
     """eventSource LIKE 's3.%' AND sourceIPAddress IN (SELECT sourceIPAddress FROM ev WHERE eventSource LIKE 's3.%' GROUP BY 1 HAVING count(DISTINCT eventName) > 1)"""),
    ("few overall", {"d": {"eventName": "AssumeRoot"}, "condition": "d | count() < 5"}, "eventName = 'AssumeRoot' AND (SELECT count(*) FROM ev WHERE eventName = 'AssumeRoot') < 5"),
]
_UNSUPPORTED = [
    ("timeframe", {"a": {"eventName": "x"}, "timeframe": "5m", "condition": "a"}), ("undefined", {"a": {"eventName": "x"}, "condition": "a and b"}),
    ("lookahead", {"a": {"eventName|re": "(?=x)"}, "condition": "a"}), ("near", {"a": {"eventName": "x"}, "condition": "a | near b"}),
]


def _rule(name, detection):
    return {"title": name, "logsource": _AWS, "detection": detection}


def _hits_sql(named: list[tuple[str, str]]) -> str:
    return with_ev(" UNION ALL ".join(f"SELECT '{n}' AS name, seq FROM ev WHERE {sql}" for n, sql in named))


def _summary_sql(named: list[tuple[str, str]]) -> str:
    return with_ev(" UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) FILTER (WHERE {sql}) AS matches, count(*) AS scanned FROM ev" for n, sql in named))


_ALL = list(_EXAMPLE_SQL.items()) + [(n, s) for n, _, s in _MODIFIER_RULES + _COUNT_RULES]


@_register("rule_examples", _hits_sql(list(_EXAMPLE_SQL.items())))
def rule_examples(spark, sf):
    return rules.run_rules(ev(spark, sf), rules.EXAMPLE_RULES)["hits"].select("name", "seq")


@_register("rule_modifiers", _hits_sql([(n, s) for n, _, s in _MODIFIER_RULES]))
def rule_modifiers(spark, sf):
    return rules.run_rules(ev(spark, sf), [_rule(n, d) for n, d, _ in _MODIFIER_RULES])["hits"].select("name", "seq")


@_register("rule_counts", _hits_sql([(n, s) for n, _, s in _COUNT_RULES]))
def rule_counts(spark, sf):
    return rules.run_rules(ev(spark, sf), [_rule(n, d) for n, d, _ in _COUNT_RULES])["hits"].select("name", "seq")


@_register("rule_suite_summary", _summary_sql(_ALL))
def rule_suite_summary(spark, sf):
    suite = rules.EXAMPLE_RULES + [_rule(n, d) for n, d, _ in _MODIFIER_RULES + _COUNT_RULES] + [_rule(n, d) for n, d in _UNSUPPORTED]
    return rules.run_rules(ev(spark, sf), suite)["summary"]


@_register("rule_explained_rows", with_ev("""SELECT * FROM (SELECT seq, row_number() OVER (ORDER BY seq DESC) AS rank, 'agent=true,console=false,write=true' AS selections
  FROM ev WHERE eventName = 'PutObject' AND eventNo % 6 <> 1) WHERE rank <= 700"""))
def rule_explained_rows(spark, sf):
    rows = rules.run_rule(ev(spark, sf), rules.EXAMPLE_RULES[2], limit=700)["rows"]
    text = F.transform("selections", lambda s: F.concat(s["name"], F.lit("="), s["matched"].cast("string")))
    return rows.select("seq", "rank", F.array_join(text, ",").alias("selections"))
