"""The key index: what it holds, how runs are merged, and how much a small batch reads of it."""

import os

from pyspark.sql import functions as F

from auditspark.plans import keyindex


def keys(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("event:"), "id").alias("eventKey"))


def found(spark, home, runs, wanted, **how):
    held = keyindex.known(wanted, home, runs, **how)
    return None if held is None else sorted(r.eventKey for r in held.collect())


def test_known_keys_by_bucket_and_by_join(spark, tmp_path):
    home = str(tmp_path)
    assert found(spark, home, [], keys(spark, 0, 5)) is None
    runs = [keyindex.write_run(keys(spark, 0, 5_000), home, 5_000, per_bucket=100), keyindex.write_run(keys(spark, 5_000, 5_010), home, 10)]
    assert runs[0]["buckets"] == 64 and runs[1]["buckets"] == 1
    wanted = keys(spark, 4_998, 5_003).union(keys(spark, 90_000, 90_004)).union(keys(spark, 4_999, 5_000))
    want = [f"event:{k}" for k in range(4_998, 5_003)]
    for few in (keyindex.FEW, 2):
        assert sorted(set(found(spark, home, runs, wanted, few=few))) == want
    assert found(spark, home, runs, keys(spark, 7, 7)) is None


def size_of(file):
    return os.path.getsize(file.removeprefix("file://").removeprefix("file:"))


def test_a_small_batch_reads_as_much_of_a_small_index_as_of_a_large_one(spark, tmp_path):
    wanted = [r["h"] for r in keys(spark, 100, 105).union(keys(spark, 10**9, 10**9 + 5)).select(F.xxhash64("eventKey").alias("h")).collect()]
    for rows in (20_000, 400_000):
        home = str(tmp_path / str(rows))
        run = keyindex.write_run(keys(spark, 0, rows), home, rows, per_bucket=2_000)
        files, every = (keyindex.opened(spark, home, [run], hashes).inputFiles() for hashes in (wanted, None))
        assert len(files) <= 10 and len(every) == run["buckets"] and max(map(size_of, files)) < 40_000


def test_absent_keys_are_skipped_by_the_bloom_filter(spark, tmp_path):
    """No row leaves the scan for hashes that lie inside a file's range but are not in it."""
    home = str(tmp_path)
    run = keyindex.write_run(keys(spark, 0, 3_000), home, 3_000)
    held = sorted(r["h"] for r in keyindex.opened(spark, home, [run], None).collect())
    for hashes, rows in ((held[100:103], 3_000), ([h + 1 for h in held[100:103]], 0)):
        scan = keyindex.opened(spark, home, [run], hashes)
        assert len(scan.collect()) == (3 if rows else 0)
        assert scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() == rows


def test_runs_of_a_size_are_merged(spark, tmp_path):
    home, runs = str(tmp_path), []
    for k in range(20):
        runs = keyindex.merged(spark, home, [*runs, keyindex.write_run(keys(spark, 10 * k, 10 * k + 10), home, 10)])
    assert len(runs) < keyindex.FANOUT and sum(r["rows"] for r in runs) == 200
    assert len(found(spark, home, runs, keys(spark, 0, 300))) == 200
    assert len(set(found(spark, home, runs, keys(spark, 0, 300), few=1))) == 200
