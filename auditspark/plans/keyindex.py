"""Keys of a dataset, stored as an index that a batch reads in parts.

The index is a list of runs.  A run is a folder of hash buckets; a bucket is one Parquet file of about KEYS_PER_BUCKET
keys, ordered by hash, with a Bloom filter over the hashes.  Every batch adds a run.  When FANOUT runs are of about the
same size they are merged into one, so there are few runs and a key is rewritten a logarithmic number of times.  A batch
of few keys opens only the buckets that its hashes fall into: what it reads depends on the batch and the number of runs,
not on how many keys are stored.  A large batch is joined with the whole index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS_PER_BUCKET = 1 << 16
FANOUT = 8
#: Least size of a tier, and the most keys of a batch that are looked up by bucket.
TIER = 1 << 10
FEW = 1 << 10
_SCHEMA = "h bigint, eventKey string"


def write_run(keys: DataFrame, home: str, rows: int, per_bucket: int = KEYS_PER_BUCKET) -> dict:
    """Store distinct keys as a run below ``home``; the result describes it."""
    buckets = 1 << max(0, (max(rows - 1, 0) // per_bucket).bit_length())
    run = {"dir": f"keys/run-{uuid.uuid4().hex}", "rows": rows, "buckets": buckets}
    hashed = keys.select(F.xxhash64("eventKey").alias("h"), "eventKey").withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    hashed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket") \
        .option("parquet.bloom.filter.enabled#h", "true").option("parquet.bloom.filter.expected.ndv#h", str(2 * per_bucket)).option("compression", "zstd").parquet(f"{home}/{run['dir']}")
    return run


def _tier(run: dict) -> int:
    tier, size = 0, TIER
    while run["rows"] >= size:
        tier, size = tier + 1, size * FANOUT
    return tier


def merged(spark: SparkSession, home: str, runs: list[dict], per_bucket: int = KEYS_PER_BUCKET) -> list[dict]:
    """The runs with every full tier merged into one; replaced runs stay on storage for those who read them."""
    runs = list(runs)
    while True:
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(_tier(run), []).append(run)
        full = next((same for _, same in sorted(tiers.items()) if len(same) >= FANOUT), None)
        if full is None:
            return runs
        keys = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(*[f"{home}/{run['dir']}" for run in full])
        runs = [run for run in runs if run not in full] + [write_run(keys.select("eventKey"), home, sum(run["rows"] for run in full), per_bucket)]


def opened(spark: SparkSession, home: str, runs: list[dict], hashes: list[int] | None) -> DataFrame:
    """Stored (h, eventKey) of the buckets that hold ``hashes`` (None: of all)."""
    reader = spark.read.schema(_SCHEMA)
    if hashes is None:
        return reader.option("recursiveFileLookup", "true").parquet(*[f"{home}/{run['dir']}" for run in runs])
    # few hashes become equality filters, which reach the Bloom filters; more are compared with the file's least and greatest
    buckets = sorted({f"{home}/{run['dir']}/bucket={h % run['buckets']}" for run in runs for h in hashes})
    return reader.parquet(*buckets).filter(F.col("h").isin(hashes))


def known(keys: DataFrame, home: str, runs: list[dict], few: int = FEW) -> DataFrame | None:
    """Those of ``keys`` (eventKey) that the index holds, or None if it holds none."""
    if not runs:
        return None
    hashed = keys.select(F.xxhash64("eventKey").alias("h"), "eventKey")
    some = [r["h"] for r in hashed.select("h").distinct().limit(few + 1).collect()]  # few rows, whatever the batch
    if not some:
        return None
    held = opened(keys.sparkSession, home, runs, some if len(some) <= few else None)
    return held.join(hashed, ["h", "eventKey"], "left_semi").select("eventKey")
