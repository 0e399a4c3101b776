"""Registered queries: the events written to files of every shape, read, imported, looked up and exported again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..model import Filter
from ..operators import lineage, maintain
from ..session import freed_shuffles, shared_folder
from ..sources import readers, sinks
from .common import KEY_SQL, ev, with_ev
from .lineage_suite import resolve_ctes

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


#: Records of a written list.
LISTED = 50


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _lists(spark, sf, before: str, after: str, item=None) -> str:
    """Compressed files whose lines list some records each, in a folder below the one returned.

    A list has LISTED records at most, so the lists grow in number with the table and not in length.
    """
    path = _folder(spark)
    texts = F.sort_array(F.collect_list(F.struct("seq", (F.col("raw") if item is None else item).alias("t"))))
    lines = ev(spark, sf).groupBy(F.floor(F.col("seq") / LISTED).alias("g")).agg(
        F.concat(F.lit(before), F.array_join(F.transform(texts, lambda x: x["t"]), ",\n "), F.lit(after)).alias("value"))
    with freed_shuffles(spark):
        lines.select("value").write.option("compression", "gzip").text(f"{path}/deep/er")
    return path


def _found(records: DataFrame) -> DataFrame:
    return records.select(F.get_json_object("raw", "$.eventID").alias("eventID"), F.sha2("raw", 256).alias("digest"), "format", "lossy",
                          (F.sha2("original", 256) == F.sha2("raw", 256)).alias("asRead"))


def _found_sql(kind: str) -> str:
    return with_ev(f"SELECT eventID, sha256(raw) AS digest, '{kind}' AS format, false AS lossy, true AS asRead FROM ev")


@_register("read_record_lists", _found_sql("cloudtrail-json"))
def read_record_lists(spark, sf):
    return _found(readers.read_records(spark, _lists(spark, sf, '{"note":{"Records":[1]},"Records":[', "]}")))


def _large(spark, sf) -> str:
    """Plain files of many top-level values, each with a list of records."""
    path = _folder(spark)
    texts = F.sort_array(F.collect_list(F.struct("seq", F.col("raw").alias("t"))))
    lists = ev(spark, sf).groupBy(F.floor(F.col("seq") / LISTED).alias("g")).agg(F.array_join(F.transform(texts, lambda x: x["t"]), ",\n ").alias("t"))
    with freed_shuffles(spark):
        lists.select(F.concat(F.lit('{"note":{"Records":[1]},"Records":['), "t", F.lit('],"end":"}"}'))).write.text(path)
    return path


@_register("read_large_lists", _found_sql("cloudtrail-json"))
def read_large_lists(spark, sf):
    """Files cut by ranges, as every file over a kilobyte is here."""
    return _found(readers.read_records(spark, _large(spark, sf), whole_bytes=1 << 10, names="*.txt"))


@_register("read_history_lists", _found_sql("event-history-json"))
def read_history_lists(spark, sf):
    quoted = F.to_json(F.array("raw"))
    wrapped = F.concat(F.lit('{"EventId":"x","CloudTrailEvent":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("}"))
    return _found(readers.read_records(spark, _lists(spark, sf, '{"Events":[', "]}", wrapped)))


@_register("read_bare_lists", _found_sql("cloudtrail-json"))
def read_bare_lists(spark, sf):
    return _found(readers.read_records(spark, _lists(spark, sf, "[", "]")))


@_register("read_single_records", _found_sql("cloudtrail-json"))
def read_single_records(spark, sf):
    path = _folder(spark)
    ev(spark, sf).select("raw").write.option("compression", "gzip").text(path)
    return _found(readers.read_records(spark, path))


@_register("read_record_lines", _found_sql("cloudtrail-json"))
def read_record_lines(spark, sf):
    path = _folder(spark)
    ev(spark, sf).select("raw").write.text(path)
    return _found(readers.read_lines(spark, path))


@_register("read_console_rows", with_ev("""SELECT eventID, nullif(eventTime, '') AS eventTime, eventName, eventSource, nullif(awsRegion, '') AS awsRegion, nullif(errorCode, '') AS errorCode, true AS lossy FROM ev"""))
def read_console_rows(spark, sf):
    path = _folder(spark)
    names = {"eventID": "Event ID", "eventTime": "Event time", "eventName": "Event name", "eventSource": "Event source", "awsRegion": "AWS region", "errorCode": "Error code"}
    table = ev(spark, sf).select(*[F.col(c).alias(n) for c, n in names.items()])
    table.write.option("compression", "gzip").option("header", "true").option("emptyValue", "").csv(path)
    rows = readers.read_records(spark, path)
    return rows.select(*[F.nullif(F.get_json_object("raw", f"$.{c}"), F.lit("")).alias(c) for c in names], "lossy")


def _imported(spark, sf) -> tuple[DataFrame, DataFrame, object]:
    """A dataset of two batches: all events but some, then all events again."""
    files, home = _lists(spark, sf, '{"Records":[', "]}"), _folder(spark)
    records = readers.read_records(spark, files)
    held = F.get_json_object("raw", "$.awsRegion") == "us-west-2"
    maintain.import_dataset(records.filter(~F.coalesce(held, F.lit(False))), home)
    snapshot = maintain.append_events(records, home, "again")
    return (*maintain.open_dataset(spark, home), snapshot)


_LATER = "coalesce(awsRegion, '') = 'us-west-2'"


@_register("imported_files", with_ev(f"""SELECT row_number() OVER (ORDER BY {_LATER}, eventTime NULLS LAST, key) AS seq, eventID, key AS eventKey, sha256(raw) AS evidenceHash
FROM (SELECT *, {KEY_SQL} AS key FROM ev)"""))
def imported_files(spark, sf):
    return _imported(spark, sf)[0].select("seq", "eventID", "eventKey", "evidenceHash")


@_register("original_by_observation", with_ev(f"SELECT eventID, sha256(raw) AS digest, CASE WHEN {_LATER} THEN 1 ELSE 2 END AS copies FROM ev"))
def original_by_observation(spark, sf):
    """Every observation looked up by its id, in an order of its own, and its original bytes; ids are unique."""
    events, observations, _ = _imported(spark, sf)
    wanted = observations.select("observationId").withColumn("place", F.xxhash64("observationId"))
    found = maintain.require_all(maintain.lookup(observations.select("observationId", "eventKey", "original"), wanted, "observationId"))
    hits = found.groupBy("eventKey").agg(F.count_distinct("observationId").cast("int").alias("copies"), F.min(F.sha2("original", 256)).alias("digest"))
    return hits.join(events.select("eventKey", "eventID"), "eventKey").select("eventID", "digest", "copies")


@_register("exported_matches", with_ev("SELECT eventID, sha256(raw) AS digest FROM ev WHERE coalesce(errorCode, '') <> ''"))
def exported_matches(spark, sf):
    events, _, snapshot = _imported(spark, sf)
    path = _folder(spark)
    sinks.export_matches(events, Filter(errors_only=True), snapshot, path)
    return sinks.exported(spark, path).select(F.get_json_object("raw", "$.eventID").alias("eventID"), F.sha2("raw", 256).alias("digest"))


@_register("issuer_with_variants", with_ev("SELECT seq, status, code, parentSeq FROM res", ctes=resolve_ctes("eventNo % 5 = 1 AND copy = 0")))
def issuer_with_variants(spark, sf):
    """Issuers when a fifth of the records has a second, different source copy."""
    events = ev(spark, sf)
    copies = events.select("eventKey", "raw").unionByName(
        events.filter("eventNo % 5 = 1 AND copy = 0").select("eventKey", F.concat("raw", F.lit(" ")).alias("raw")))
    return lineage.resolve_issuers(events, copies).select("seq", "status", F.col("reasonCode").alias("code"), "parentSeq")


@_register("dump_places", with_ev("SELECT seq, row_number() OVER (ORDER BY ts NULLS LAST, seq) AS place FROM ev"))
def dump_places(spark, sf):
    return maintain.dump_places(ev(spark, sf), "seq")
