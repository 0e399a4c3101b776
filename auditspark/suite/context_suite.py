"""Registered queries: events around anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import investigate
from .common import ev, with_ev
from .hunt_suite import _REFS

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _anchors(events):
    """Refused trail changes and secret reads by a root identity: the events an analyst would start from."""
    return events.filter(((F.col("eventName") == "StopLogging") & (F.col("errorCode") == "Client.UnauthorizedOperation"))
                         | ((F.col("eventName") == "Decrypt") & (F.col("identityType") == "Root"))).select("seq")


_ANCHOR_SQL = """((eventName = 'StopLogging' AND errorCode = 'Client.UnauthorizedOperation') OR (eventName = 'Decrypt' AND identityType = 'Root'))"""
_CTX = f"""{_REFS},
arns AS (SELECT seq, list(DISTINCT arn) AS arns FROM refs GROUP BY 1),
ctx AS (SELECT ev.seq, eventMs, eventSource, eventName, recipientAccountId, awsRegion, identityArn, accessKeyId, sourceIPAddress,
  json_extract_string(raw, '$.sharedEventID') AS sharedID, json_extract_string(raw, '$.requestID') AS requestID,
  coalesce(arns, []) AS arns, {_ANCHOR_SQL} AS isAnchor FROM ev LEFT JOIN arns ON arns.seq = ev.seq WHERE eventMs IS NOT NULL),
pairs AS (SELECT a.seq AS anchor, e.seq AS seq, e.eventMs, e.eventMs - a.eventMs AS deltaMs, a.sharedID AS aShared, a.requestID AS aRequest,
    a.accessKeyId AS aKey, a.identityArn AS aArn, a.sourceIPAddress AS aIp,
    coalesce(a.sharedID <> '' AND a.sharedID = e.sharedID AND a.eventSource <> '' AND a.eventSource = e.eventSource AND a.eventName <> '' AND a.eventName = e.eventName, false) AS shared,
    coalesce(a.requestID <> '' AND a.requestID = e.requestID AND a.eventSource = e.eventSource AND a.eventName = e.eventName AND a.recipientAccountId <> '' AND a.recipientAccountId = e.recipientAccountId AND a.awsRegion <> '' AND a.awsRegion = e.awsRegion, false) AS request,
    coalesce(a.accessKeyId <> '' AND a.accessKeyId = e.accessKeyId AND a.identityArn <> '' AND a.identityArn = e.identityArn, false) AS credential,
    coalesce(a.identityArn <> '' AND a.identityArn = e.identityArn, false) AS principal,
    coalesce(a.sourceIPAddress NOT LIKE '%com' AND a.sourceIPAddress = e.sourceIPAddress, false) AS ip,
    list_sort(list_intersect(a.arns, e.arns)) AS common
  FROM ctx a JOIN ctx e ON a.isAnchor AND e.eventMs BETWEEN a.eventMs - {{d}} AND a.eventMs + {{d}})"""
_REASONS = """CASE WHEN seq = anchor THEN 'anchor=' ELSE coalesce(nullif(concat_ws(';', CASE WHEN shared THEN 'shared=' || aShared END,
  CASE WHEN request THEN 'request=' || aRequest END, CASE WHEN credential THEN 'credential=' || aKey WHEN principal THEN 'principal=' || aArn END,
  CASE WHEN len(common) > 0 THEN array_to_string([ 'resource=' || x for x in common], ';') END, CASE WHEN ip THEN 'ip=' || aIp END), ''), 'time=') END"""
_WHERE = {"all": "true", "related": "shared OR request OR credential OR principal OR ip OR len(common) > 0", "principal": "principal",
          "credential": "credential", "ip": "ip", "request": "request", "shared": "shared", "resources": "len(common) > 0"}


def _sql(minutes: int, relation: str, cap: int) -> str:
    ctes = _CTX.replace("{d}", str(minutes * 60000))
    return with_ev(f"""SELECT * FROM (SELECT anchor, seq, eventMs, deltaMs, row_number() OVER (PARTITION BY anchor
  ORDER BY seq = anchor DESC, abs(deltaMs), eventMs, seq) AS rank, {_REASONS} AS reasons, count(*) OVER (PARTITION BY anchor) > {cap} AS truncated
FROM pairs WHERE seq = anchor OR ({_WHERE[relation]})) WHERE rank <= {cap}""", ctes=ctes)


def _around(name, minutes, relation, cap):
    @_register(name, _sql(minutes, relation, cap))
    def run(spark, sf):
        events = ev(spark, sf)
        rows = investigate.surrounding(events, _anchors(events), minutes, relation, cap)
        spelled = F.transform("reasons", lambda r: F.concat(r["kind"], F.lit("="), r["value"]))
        return rows.withColumn("reasons", F.array_join(spelled, ";"))
    return run


_around("context_all", 30, "all", 500)
_around("context_closest", 60, "all", 5)
_around("context_related", 60, "related", 500)
_around("context_principal", 60, "principal", 2)
_around("context_resources", 60, "resources", 500)
_around("context_request", 60, "request", 500)


# Every event of one type is an anchor, on a clock of days: a few milliseconds hold all events.
_DENSE_DAY = 86_400_000


@_register("context_dense", with_ev("""SELECT anchor, seq, rank, n > 6 AS truncated FROM (SELECT a.seq AS anchor, e.seq, count(*) OVER (PARTITION BY a.seq) AS n,
  row_number() OVER (PARTITION BY a.seq ORDER BY a.seq = e.seq DESC, abs(a.eventMs - e.eventMs), e.eventMs, e.seq) AS rank
FROM ev a JOIN ev e ON a.eventName = 'ListBuckets' AND a.eventMs = e.eventMs) WHERE rank <= 6""", _DENSE_DAY))
def context_dense(spark, sf):
    events = ev(spark, sf, _DENSE_DAY)
    anchors = events.filter("eventName = 'ListBuckets'").select("seq")
    return investigate.surrounding(events, anchors, 60, "all", 6).select("anchor", "seq", "rank", "truncated")


def _totals(name, minutes, relation):
    sql = with_ev(f"SELECT anchor, count(*) AS total FROM pairs WHERE seq = anchor OR ({_WHERE[relation]}) GROUP BY 1",
                  ctes=_CTX.replace("{d}", str(minutes * 60000)))

    @_register(name, sql)
    def run(spark, sf):
        events = ev(spark, sf)
        return investigate.context_totals(events, _anchors(events), minutes, relation)
    return run


_totals("context_totals_all", 60, "all")
_totals("context_totals_related", 60, "related")


# A clock of hours: a window holds a large part of all events, and many share its milliseconds.
_DENSE_HOUR = 3_600_000


def _dense_totals(name, relation):
    sql = with_ev(f"SELECT anchor, count(*) AS total FROM pairs WHERE seq = anchor OR ({_WHERE[relation]}) GROUP BY 1", _DENSE_HOUR, _CTX.replace("{d}", "3600000"))

    @_register(name, sql)
    def run(spark, sf):
        events = ev(spark, sf, _DENSE_HOUR)
        return investigate.context_totals(events, _anchors(events), 60, relation)
    return run


_dense_totals("context_totals_dense_all", "all")
_dense_totals("context_totals_dense_related", "related")
_dense_totals("context_totals_dense_resources", "resources")


@_register("context_shown_of_total", with_ev(f"""SELECT anchor, seq, rank, total FROM (SELECT anchor, seq, count(*) OVER (PARTITION BY anchor) AS total,
  row_number() OVER (PARTITION BY anchor ORDER BY seq = anchor DESC, abs(deltaMs), eventMs, seq) AS rank
FROM pairs WHERE seq = anchor OR ({_WHERE["related"]})) WHERE rank <= 4""", ctes=_CTX.replace("{d}", "1800000")))
def context_shown_of_total(spark, sf):
    events = ev(spark, sf)
    return investigate.surrounding(events, _anchors(events), 30, "related", 4, totals=True).select("anchor", "seq", "rank", "total")


@_register("anchor_resources", with_ev(f"""SELECT * FROM (SELECT seq, arn, kind, source, row_number() OVER (PARTITION BY seq ORDER BY arn, source) AS rank,
  count(*) OVER (PARTITION BY seq) > 100 AS truncated FROM (SELECT DISTINCT refs.seq, arn, kind, source FROM refs JOIN ev ON ev.seq = refs.seq WHERE eventName IN ('PutObject', 'GetSecretValue'))) WHERE rank <= 100""", ctes=_REFS))
def anchor_resources(spark, sf):
    events = ev(spark, sf)
    return investigate.anchor_resources(events, events.filter(F.col("eventName").isin("PutObject", "GetSecretValue")).select("seq"))
