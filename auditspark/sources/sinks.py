"""Exports: all matches as record shards, and the evidence bundle of a context."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..model import Filter, Snapshot
from ..operators.search import apply_filter
from ..session import checkpoint, freed_shuffles
from .pointer import write_text


def export_matches(events: DataFrame, f: Filter | None, snapshot: Snapshot, path: str) -> int:
    """Write ``raw`` of all matches, newest first, as line shards plus a manifest; returns the count.

    Shards are range-partitioned by descending seq, so their name order is the
    page order.  A record stands on its line as it is; one with line breaks is written as a JSON list of that one text,
    so ``exported`` gives every record back exactly.  A record that is no JSON cancels before anything is written.
    """
    rows = apply_filter(snapshot.of(events), f).select("seq", "raw")
    broken = F.from_json("raw", "_bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    total, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.col("raw").isNull() | F.coalesce(broken, F.lit(False)))).first()
    if bad:
        raise ValueError(f"{bad} of the stored records cannot be read as JSON, so nothing is written")
    newest = F.col("seq").desc()
    line = F.when(F.col("raw").rlike(r"[\r\n]|^\s*\["), F.to_json(F.array("raw"))).otherwise(F.col("raw"))
    with freed_shuffles(rows.sparkSession):
        rows.repartitionByRange(newest).sortWithinPartitions(newest).select(line.alias("value")) \
            .write.mode("errorifexists").text(f"{path}/records")
    write_text(rows.sparkSession, f"{path}/manifest.json", json.dumps(
        {"count": total, "generation": snapshot.generation, "maxSeq": snapshot.max_seq}))
    return total


def exported(spark, path: str) -> DataFrame:
    """(raw) records of an export, exactly as stored."""
    value = F.col("value")
    return spark.read.text(f"{path}/records").select(F.when(value.startswith("["), F.get(F.from_json(value, "array<string>"), F.lit(0))).otherwise(value).alias("raw"))


def bundle_tables(context: DataFrame, events: DataFrame, observations: DataFrame, store: bool = False) -> dict[str, DataFrame]:
    """Events, every source copy and one manifest row per event of a context (a frame with ``seq``).

    With ``store`` the chosen events and copies are stored, so that what reads them does not look for them in all
    observations again.
    """
    stored = checkpoint if store else (lambda rows: rows)
    chosen = stored(events.join(context.select("seq").distinct(), "seq", "left_semi"))
    copies = stored(observations.join(chosen.select("seq", "eventKey", "evidenceHash", F.sha2("raw", 256).alias("rawHash")), "eventKey")
                    .withColumn("displayed", F.col("sha256") == F.col("evidenceHash")))
    manifest = copies.groupBy("seq").agg(
        F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("original")).alias("bytes"),
        F.count_distinct("sha256").alias("variants"), F.count_if("displayed").alias("displayed"),
        F.count_if(F.sha2("original", 256) != F.col("sha256")).alias("hashMismatches"),
        F.count_if(F.col("displayed") & (F.sha2("raw", 256) != F.col("rawHash"))).alias("displayMismatches"))
    return {"events": chosen, "sources": copies.drop("rawHash"), "manifest": manifest}


def export_bundle(context: DataFrame, events: DataFrame, observations: DataFrame, path: str, max_copies: int | None = None,
                  max_source_bytes: int | None = None, max_metadata_bytes: int | None = None) -> dict[str, int]:
    """Check integrity and, where given, bounds, then write the three tables; returns the totals."""
    tables = bundle_tables(context, events, observations, store=True)
    meta = tables["events"].agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    sums = tables["manifest"].agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "copies", "bytes", "hashMismatches", "displayMismatches")], F.count_if(F.col("displayed") == 0).alias("undisplayed")).first()
    if sums["hashMismatches"] or sums["displayMismatches"] or sums["undisplayed"]:
        raise ValueError("stored evidence does not match its hashes; nothing was exported")
    bounds = ((sums["copies"], max_copies), (sums["bytes"], max_source_bytes), (meta, max_metadata_bytes))
    if any(most is not None and n > most for n, most in bounds):
        raise ValueError(f"a bundle of {sums['copies']} copies and {sums['bytes']} bytes is larger than allowed")
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    return {"copies": sums["copies"], "bytes": sums["bytes"]}
