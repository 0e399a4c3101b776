"""Shared parts of the registered queries: inputs and their DuckDB counterparts."""

from __future__ import annotations

from ..sources.audit_view import audit_events, audit_events_sql

HOUR_MS = 3_600_000


def ev(spark, sf_dir, tick_ms: int = 1):
    return audit_events(spark, sf_dir, tick_ms)


def with_ev(body: str, tick_ms: int = 1, ctes: str = "") -> str:
    """``body`` over the CTE ``ev`` holding the same audit events."""
    extra = f", {ctes}" if ctes else ""
    return f"WITH RECURSIVE ev AS ({audit_events_sql(tick_ms)}){extra}\n{body}"


# What the fixture's numbering implies, so that cross-checks need no look into the record text.
ACCOUNT_SQL = "lpad(CAST(userNo % 25 AS VARCHAR), 12, '0')"
_ISSUED_TO = "(CASE WHEN eventNo % 23 = 0 THEN userNo WHEN eventNo % 7 = 0 THEN greatest(userNo - 2, 0) ELSE userNo + 1 + eventNo % 4 END)"
ASKED_ROLE_SQL = f"'arn:aws:iam::' || lpad(CAST({_ISSUED_TO} % 25 AS VARCHAR), 12, '0') || ':role/role-' || {_ISSUED_TO} % 7"
USER_SQL = """(CASE WHEN copy = 1 THEN 'AWSAccount' WHEN userNo % 5 < 2 THEN 'role-' || userNo % 7 WHEN userNo % 5 = 2 THEN 'u' || userNo
  WHEN userNo % 5 = 3 THEN 'f' || userNo WHEN userNo % 2 = 0 THEN 'root' ELSE 'AWSService' END)"""
RESULT_SQL = "coalesce(nullif(errorCode, ''), 'Success')"
RECORDED_RO_SQL = "(CASE WHEN json_type(raw, '$.readOnly') = 'BOOLEAN' THEN json_extract_string(raw, '$.readOnly') = 'true' END)"
HAS_ERROR_SQL = "(coalesce(errorCode, '') <> '' OR coalesce(errorMessage, '') <> '')"
#: Logical key of a stored event.
KEY_SQL = """CASE WHEN recipientAccountId IS NOT NULL THEN 'event:["' || recipientAccountId || '","' || eventID || '"]' ELSE 'content:' || sha256(raw) END"""
#: Per access key: the event that speaks for it, and in how many ways its most varied part is spelled.
KEY_CTES = """first_rows AS (SELECT ifnull(min(CASE WHEN length(identityArn) > 0 THEN seq END), min(seq)) AS seq FROM ev WHERE length(accessKeyId) > 0 GROUP BY accessKeyId),
spelled AS (SELECT DISTINCT accessKeyId, unnest([['arn', identityArn], ['type', identityType], ['role', roleArn], ['account', accountId]]) AS part FROM ev WHERE length(accessKeyId) > 0),
spellings AS (SELECT accessKeyId, max(ways) AS variants FROM (SELECT accessKeyId, part[1] AS name, sum(CASE WHEN length(part[2]) > 0 THEN 1 ELSE 0 END) AS ways FROM spelled GROUP BY ALL) AS counted GROUP BY accessKeyId)"""
