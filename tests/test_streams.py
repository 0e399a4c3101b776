"""Streams over restarts: bounded state of redelivered messages, counted rejects, followed commits."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from auditspark.operators import maintain
from auditspark.session import small_table
from auditspark.sources.readers import record_of
from auditspark.streaming import intake


def line(k):
    return '{"eventName":"N","eventID":"n%d","recipientAccountId":"9","eventTime":"2024-01-01T00:00:00Z"}' % k


def test_state_of_redelivered_messages_stays_bounded(spark, tmp_path):
    """Ten rounds of ten messages, each round an hour after the last and each message twice; two restarts."""
    queue, home, rejects, progress = (str(tmp_path / n) for n in ("queue", "data", "rejects", "progress"))
    counts = intake.IntakeCounts()
    spark.streams.addListener(counts)
    for rounds in (range(0, 4), range(4, 7), range(7, 10)):
        for r in rounds:
            at = datetime.datetime(2024, 1, 1, r)
            rows = [(line(10 * r + k), at + datetime.timedelta(minutes=m)) for k in range(10) for m in (0, 5)]
            rows += [(line(10 * r - 1), at + datetime.timedelta(minutes=1))] if r else []  # the last one of the round before, again after an hour
            rows.append(("no record", at))
            small_table(spark, rows, "value string, at timestamp_ntz").select("value", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(queue)
            messages = spark.readStream.schema("value string, at timestamp").parquet(queue)
            query = intake.start_intake(messages, home, rejects, progress, within="90 minutes", arrival=F.col("at"), availableNow=True)
            query.awaitTermination()
            counts.finished(query)
    spark.streams.removeListener(counts)
    events, observations = maintain.open_dataset(spark, home)
    assert events.count() == 100 and observations.count() == 100  # nothing twice, nothing lost
    assert max(counts.state_rows.values()) <= 4 * 11  # of 110 keys
    assert sum(m for m, _ in counts.counts.values()) == 10 * 21 + 9 and sum(r for _, r in counts.counts.values()) == 10


def test_rejects_are_counted_as_they_are_observed(spark, tmp_path):
    queue, home, rejects, progress = (str(tmp_path / n) for n in ("queue", "data", "rejects", "progress"))
    counts = intake.IntakeCounts()
    spark.streams.addListener(counts)
    for batch, rows in enumerate(([line(1), "x", "y"], ["z"], [line(2), line(1)])):
        small_table(spark, [(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(queue)
        query = intake.start_intake(spark.readStream.text(queue), home, rejects, progress, availableNow=True)
        query.awaitTermination()
        counts.finished(query)
    spark.streams.removeListener(counts)
    assert [counts.counts[k] for k in sorted(counts.counts)] == [(3, 2), (1, 1), (2, 0)]
    assert sorted(r.rejects for r in intake.reject_counts(spark, rejects).collect()) == [1, 2]
    assert maintain.open_dataset(spark, home)[0].count() == 2


def test_followed_commits(spark, tmp_path):
    home, progress, seen, fail = str(tmp_path / "data"), str(tmp_path / "progress"), [], []
    records = lambda first, last: intake.batch_records(small_table(spark, [(line(k),) for k in range(first, last)], "raw string"), "s")

    def each(events, version):
        if fail:
            raise RuntimeError(fail.pop())
        seen.append((version, sorted(r.seq for r in events.collect())))

    def follow():
        intake.follow_dataset(spark, home, each, progress, F.col("seq") != 2, availableNow=True).awaitTermination()

    maintain.import_dataset(records(0, 3), home)
    follow()
    assert seen == [(1, [1, 3])]
    maintain.append_events(records(2, 5), home)
    with pytest.raises(ValueError):
        maintain.append_events(records(9, 12).withColumn("raw", F.lit("{")), home)
    maintain.append_events(records(0, 2), home)  # adds observations only
    maintain.compact_dataset(spark, home)
    fail.append("cut off")
    with pytest.raises(Exception):
        follow()
    follow()  # the commit that was cut off is given again
    assert seen[1:] == [(2, [4, 5])]
    maintain.import_dataset(records(20, 22), home)  # another generation
    follow()
    follow()
    assert seen[2:] == [(5, [1])]


def test_a_message_is_read_in_one_pass(monkeypatch):
    made = []

    class Counted(json.JSONDecoder):
        def __init__(self, *args, **more):
            made.append(1)
            super().__init__(*args, **more)

    record = '{"eventName":"N","eventID":"1",' + ",".join(f'"m{k}": {k}.10' for k in range(40)) + "}"
    decoder = json.JSONDecoder()
    monkeypatch.setattr(json, "JSONDecoder", Counted)
    assert record_of(record) == record and len(made) == 1
    wrapped = {f' {{"detail-type":"t","detail": {record} }} ': record, json.dumps({"Type": "Notification", "Message": record}): record, f'{{"detail":1,"detail":{record}}}': record,
               record + "x": None, "[1]": None, "no record " + record: None, "": None, None: None, '{"eventName":"N","eventID":1}': None, '{"eventName":"N","eventID":"1",}': None,
               json.dumps({"Type": "Notification", "Message": 5, "eventName": "a", "eventID": "b"}): json.dumps({"Type": "Notification", "Message": 5, "eventName": "a", "eventID": "b"})}
    for message, want in wrapped.items():
        assert record_of(message, decoder=decoder) == want, message
