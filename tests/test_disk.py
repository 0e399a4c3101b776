"""What imports, exports and intake leave on disk beside what they are to write."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditspark.model import Filter
from auditspark.operators import maintain
from auditspark.session import freed_shuffles, put_aside, release, scratch, shared_folder, small_table
from auditspark.sources import sinks
from auditspark.streaming import intake

FIELDS = "raw string, original string, source string, ordinal bigint, format string, lossy boolean, error string"


def noise(k, size=400):
    return "%0*x" % (size, random.Random(k).getrandbits(4 * size))


def text(k):
    return '{"eventName":"N","eventID":"n%d","recipientAccountId":"9","errorCode":"%s","eventTime":"2024-01-%02dT00:00:00Z","x":"%s"}' % (k, "E" * (k % 2), 1 + k % 28, noise(k))


def records(spark, first, last):
    rows = [(text(k), text(k) + "\n" * (k % 5 == 0), "s", k, "cloudtrail-json", False, None) for k in range(first, last)]
    return small_table(spark, rows, FIELDS).repartition(3)


def shuffles(spark):
    """Shuffle files with more in them than a few totals."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    paths = [Path(p) for p in re.findall(r"/[^,() ]*shuffle_[^,() ]*\.data", found)]
    return {p for p in paths if p.exists() and p.stat().st_size > 500}


def files(spark):
    top = Path(shared_folder(spark).removeprefix("file:"))
    return {str(p): p.stat().st_size for p in top.rglob("*") if p.is_file()}


def test_an_import_leaves_its_tables_only(spark, tmp_path):
    home = str(tmp_path / "data")
    files_before, shuffles_before = files(spark), shuffles(spark)
    maintain.import_dataset(records(spark, 0, 60), home)
    snapshot = maintain.append_events(records(spark, 30, 90), home)
    assert files(spark).keys() <= files_before.keys()  # no narrow rows, no checkpoints
    assert not shuffles(spark) - shuffles_before
    events, observations = maintain.open_dataset(spark, home)
    assert [r.raw for r in events.orderBy("seq").collect() if r.seq <= 60] == sorted((text(k) for k in range(60)), key=lambda t: (json.loads(t)["eventTime"], f'event:["9","{json.loads(t)["eventID"]}"]'))
    assert events.count() == 90 and snapshot.max_seq == 90
    shuffles_before = shuffles(spark)
    assert sinks.export_matches(events, Filter(errors_only=True), snapshot, str(tmp_path / "export")) == 45
    assert not shuffles(spark) - shuffles_before


def test_an_original_is_written_once(spark, tmp_path):
    home = str(tmp_path / "data")
    given = records(spark, 0, 20).unionByName(small_table(spark, [(text(50), None, "s", 50, "live", False, None)], FIELDS))
    maintain.import_dataset(given, home)
    maintain.append_events(records(spark, 20, 40), home)
    _, observations = maintain.open_dataset(spark, home)
    want = {k: text(k) + "\n" * (k % 5 == 0) for k in range(40)} | {50: None}
    for _ in range(2):
        assert {r.ordinal: r.original for r in observations.collect()} == want
        assert {r.ordinal for r in observations.filter("original IS NULL").collect()} == {50}
        written = spark.read.option("recursiveFileLookup", "true").parquet(*[str(p) for p in Path(home).glob("gen-*/observations")])
        assert {r.ordinal for r in written.filter("original IS NOT NULL").collect()} >= {0, 5, 10, 15}
        assert written.filter("original = raw").count() == 0
        maintain.compact_dataset(spark, home)
        _, observations = maintain.open_dataset(spark, home)


def test_an_intake_batch_keeps_no_copy_of_its_messages(spark, tmp_path):
    bodies = [text(k) for k in range(40)] + ["no record " + noise(k) for k in range(5)] + [text(7)] * 2
    files_before, shuffles_before = files(spark), shuffles(spark)
    intake.intake_batch(small_table(spark, [(b,) for b in bodies], "value string").repartition(3), 0, str(tmp_path / "data"), str(tmp_path / "rejects"))
    new = {p: n for p, n in files(spark).items() if p not in files_before}
    assert sum(new.values()) < 5000, new
    assert not shuffles(spark) - shuffles_before
    events, observations = maintain.open_dataset(spark, str(tmp_path / "data"))
    assert events.count() == 40 and observations.count() == 42 and observations.select("ordinal").distinct().count() == 42
    assert intake.reject_counts(spark, str(tmp_path / "rejects")).first()["rejects"] == 5


@pytest.mark.parametrize("few", [0, 1, 1 << 14])
def test_only_repeated_texts_are_numbered(spark, monkeypatch, few):
    monkeypatch.setattr(intake, "FEW_COPIES", few)
    rows = small_table(spark, [(text(k),) for k in [*range(30), 3, 3, 4]], "raw string")
    got = intake.batch_records(rows, "s")
    copies = [(text(k), n) for k in range(30) for n in range(1, {3: 4, 4: 3}.get(k, 2))]
    want = small_table(spark, copies, "raw string, n int").select("raw", F.xxhash64("raw", "n").alias("ordinal"))
    assert sorted((r.raw, r.ordinal) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert got.columns == FIELDS.replace(" string", "").replace(" bigint", "").replace(" boolean", "").split(", ")


def test_texts_that_come_once_are_not_shuffled(spark):
    with scratch(spark) as folder:
        stored = put_aside(small_table(spark, [(text(k),) for k in [*range(30), 3]], "raw string"), folder)
        assert stored.count() == 31
        plan = intake.batch_records(stored, "s")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window") == 1 and "LeftSemi" in plan and "LeftAnti" in plan
        held = Path(folder.removeprefix("file:"))
        assert held.exists()
    assert not held.exists()


def test_a_lookup_that_is_checked_leaves_no_shuffle(spark):
    shuffles_before, held = shuffles(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"))
        found = maintain.require_all(maintain.lookup(table, table.select("id"), "id"))
        assert not shuffles(spark) - shuffles_before
        assert found.count() == 2000
        with pytest.raises(ValueError):
            maintain.require_all(maintain.lookup(table, table.select(F.concat("id", F.lit("x")).alias("id")), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_what_has_ended_is_cleaned(spark):
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with freed_shuffles(spark):
        before = shuffles(spark)
        assert frame.select("k").count() == 7 and not shuffles(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    release(spark)
