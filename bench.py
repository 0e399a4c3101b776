"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
(comma-separated) narrows the list.  The import of the events into their stored
table is its own entry.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import functions as F

from auditspark.operators import maintain
from auditspark.session import local_session, shared_folder
from auditspark.sources.audit_view import audit_events
from auditspark.suite import registry

HEADLINE = [
    "search_facets_filtered", "search_facets_all", "search_stats", "search_histogram", "filter_rows", "page_newest", "page_keyset",
    "extract_event_columns", "compare_periods", "activity_stats", "key_identities", "indicator_totals", "indicator_matches",
    "sequence_two_steps", "sequence_three_steps_ties", "sequence_five_steps_credential", "rule_examples", "rule_counts",
    "rule_suite_summary", "context_all", "context_related", "context_totals_all", "resource_references", "issuer_of_every_use",
    "ancestry_of_every_use", "children_of_every_key", "credential_activity", "first_copies", "numbered_events", "evidence_stats",
    "field_profile", "version_changes", "federated_identities", "broker_identities", "unwrapped_messages",
]


def store_times(spark, sf_dir: str) -> dict[str, float]:
    """Import into a stored dataset, one raw event by number, and a batch of ten events."""
    home = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    record = F.struct("raw")
    events = audit_events(spark, sf_dir)
    records = events.select("raw", F.col("raw").alias("original"), F.lit("bench").alias("source"), F.col("seq").alias("ordinal"),
                            F.lit("bench").alias("format"), F.lit(False).alias("lossy"), F.lit(None).cast("string").alias("error"))
    out = {}

    def timed(name, action):
        start = time.time()
        action()
        out[name] = round(time.time() - start, 3)

    timed("import_dataset", lambda: maintain.import_dataset(records, home))
    stored = maintain.open_dataset(spark, home)[0]
    timed("raw_event", lambda: stored.filter("seq = 77").select(record).collect())
    ten = records.filter("ordinal <= 20").withColumns({c: F.replace(F.col(c), F.lit('"eventID":"ev-'), F.lit('"eventID":"new-')) for c in ("raw", "original")})
    timed("append_ten_events", lambda: maintain.append_events(ten.limit(10), home))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), "auditspark-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times: dict[str, float] = {}
    start = time.time()
    rows = audit_events(spark, sf_dir).count()
    times["import_events"] = round(time.time() - start, 3)
    registry.QUERIES["search_stats"](spark, sf_dir).collect()  # warm-up, not timed
    if not wanted:
        times.update(store_times(spark, sf_dir))
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).removeprefix("sf"), "events": rows, "cpus": os.environ.get("BENCH_CPUS", "8")}))


if __name__ == "__main__":
    main()
