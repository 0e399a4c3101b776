"""All registered queries."""

from __future__ import annotations

from . import context_suite, evidence_suite, file_suite, hunt_suite, lineage_suite, rule_suite, search_suite, stream_suite

QUERIES: dict = {}
ORACLES: dict = {}
for _suite in (search_suite, hunt_suite, rule_suite, context_suite, lineage_suite, evidence_suite, file_suite, stream_suite):
    QUERIES.update(_suite.QUERIES)
    ORACLES.update(_suite.ORACLES)
