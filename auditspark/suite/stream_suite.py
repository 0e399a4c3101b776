"""Registered queries: live intake with counted rejects, redelivered messages, and followed commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import maintain
from ..session import release, shared_folder
from ..streaming import intake
from .common import KEY_SQL, ev, with_ev

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _messages(spark, sf) -> DataFrame:
    """Every event as a plain record, in a bus envelope, or as a message without a record; (eventNo, value)."""
    value = F.when(F.col("eventNo") % 7 == 3, F.concat(F.lit("no record "), "raw")) \
        .when(F.col("eventNo") % 2 == 0, F.concat(F.lit('{"detail-type":"AWS API Call via CloudTrail","detail":'), "raw", F.lit("}"))).otherwise(F.col("raw"))
    return ev(spark, sf).filter("coalesce(eventID, '') <> ''").select("eventNo", value.alias("value"))


_DATA = "coalesce(eventID, '') <> ''"


@_register("intake_counts", with_ev(f"""SELECT count(*) AS messages, count(*) FILTER (WHERE eventNo % 7 = 3) AS rejects, count(*) FILTER (WHERE eventNo % 7 = 3) AS stored,
  count(DISTINCT eventKey) FILTER (WHERE eventNo % 7 <> 3) AS events, count(*) FILTER (WHERE eventNo % 7 <> 3) AS observations FROM ev WHERE {_DATA}"""))
def intake_counts(spark, sf):
    """Messages and rejects as the batches observed them, beside the rejects and events that are stored."""
    queue, home, rejects, progress = (_folder(spark) for _ in range(4))
    _messages(spark, sf).select("value").write.option("compression", "gzip").text(queue)
    counts = intake.IntakeCounts()
    spark.streams.addListener(counts)
    query = intake.start_intake(spark.readStream.text(queue), home, rejects, progress, availableNow=True)
    query.awaitTermination()
    seen = list(counts.finished(query).counts.values())
    spark.streams.removeListener(counts)
    events, observations = maintain.open_dataset(spark, home)
    stored = intake.reject_counts(spark, rejects).agg(F.coalesce(F.sum("rejects"), F.lit(0)).alias("stored"))
    return stored.select(F.lit(sum(m for m, _ in seen)).cast("bigint").alias("messages"), F.lit(sum(r for _, r in seen)).cast("bigint").alias("rejects"), "stored",
                         events.agg(F.count(F.lit(1))).scalar().alias("events"), observations.agg(F.count(F.lit(1))).scalar().alias("observations"))


@_register("redelivered_messages", with_ev(f"SELECT {KEY_SQL} AS eventKey, 1 AS copies FROM ev WHERE {_DATA} AND eventNo % 7 <> 3"))
def redelivered_messages(spark, sf):
    """Every message delivered again some minutes later, two fifths a third time, the stream restarted in between."""
    queue, home, rejects, progress = (_folder(spark) for _ in range(4))
    for minute, part in enumerate((F.lit(True), F.lit(True), F.col("eventNo") % 5 < 2)):
        at = F.to_timestamp(F.lit(f"2024-01-01 00:{10 * minute:02d}:00"))
        _messages(spark, sf).filter(part).select("value", at.alias("at")).write.mode("append").option("compression", "zstd").parquet(queue)
        messages = spark.readStream.schema("value string, at timestamp").parquet(queue)
        intake.start_intake(messages, home, rejects, progress, within="1 hour", arrival=F.col("at"), availableNow=True).awaitTermination()
        release(spark)
    return maintain.open_dataset(spark, home)[1].groupBy("eventKey").agg(F.count(F.lit(1)).cast("int").alias("copies"))


_LATER = "coalesce(awsRegion, '') = 'us-west-2'"


@_register("followed_commits", with_ev(f"""SELECT CASE WHEN {_LATER} THEN 2 ELSE 1 END AS version, row_number() OVER (ORDER BY {_LATER}, eventTime NULLS LAST, key) AS seq, key AS eventKey
FROM (SELECT *, {KEY_SQL} AS key FROM ev) QUALIFY coalesce(errorCode, '') <> ''"""))
def followed_commits(spark, sf):
    """Failed calls of a dataset as its commits are followed, with a restart, a refused batch and a compaction between."""
    home, given, progress = (_folder(spark) for _ in range(3))
    record = [F.col("raw"), F.col("raw").alias("original"), F.lit("s").alias("source"), F.col("seq").alias("ordinal"), F.lit("live").alias("format"),
              F.lit(False).alias("lossy"), F.lit(None).cast("string").alias("error")]
    later = F.coalesce(F.col("awsRegion") == "us-west-2", F.lit(False))

    def keep(events: DataFrame, version: int) -> None:
        events.select(F.lit(version).alias("version"), "seq", "eventKey").write.mode("overwrite").parquet(f"{given}/{version}")

    def follow() -> None:
        intake.follow_dataset(spark, home, keep, progress, F.coalesce(F.col("errorCode"), F.lit("")) != "", availableNow=True).awaitTermination()

    maintain.import_dataset(ev(spark, sf).filter(~later).select(*record), home)
    follow()
    maintain.append_events(ev(spark, sf).filter(later).select(*record), home, "later")
    try:
        maintain.append_events(ev(spark, sf).limit(5).select(*record).withColumn("raw", F.lit("{")), home, "bad")
    except ValueError:
        pass  # the batch is refused, and what it wrote is never seen
    maintain.compact_dataset(spark, home)
    follow()
    return spark.read.schema("version int, seq bigint, eventKey string").parquet(f"{given}/*")
