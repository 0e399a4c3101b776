"""Event and observation tables: validation, first copies, numbering, import, append, evidence."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.facts import with_facts
from ..functions.labels import content_key
from ..functions.records import EVENT_COLUMNS, extract_events
from ..model import Snapshot
from ..plans import keyindex
from ..plans.numbering import number_rows
from ..session import freed_shuffles, scratch, small_table
from ..sources.pointer import create_text, names_in, read_text
from .aggregates import top_rows

EVIDENCE_PAGE = 25
#: Number of a written observation, and what stands before a batch name in the key index (event keys begin otherwise).
_ROW, _BATCH_KEY = "_written", "batch:"
OBSERVATION_COLUMNS = ("observationId", "position", "eventKey", "sha256", "raw", "original", "source", "ordinal", "format", "lossy", "observedAt")


def invalid_records(records: DataFrame) -> DataFrame:
    """Records that are no audit event: unreadable source, broken JSON, several values, no event name."""
    name = F.get_json_object("raw", "$.eventName")
    broken = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    # duplicate members are legal evidence, so the check is not try_parse_json
    corrupt = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("raw"), F.lit("]"))), F.lit(0)) != 1
    return records.filter(broken | F.col("raw").isNull() | corrupt | (F.coalesce(name, F.lit("")) == ""))


def observations_of(records: DataFrame) -> DataFrame:
    """Records with logical key and source hash; ``position`` orders copies (source, ordinal)."""
    keyed = records.withColumns({
        "sha256": F.sha2("original", 256),
        "eventKey": content_key(F.get_json_object("raw", "$.recipientAccountId"), F.get_json_object("raw", "$.eventID"), F.col("original")),
        "observedAt": F.current_timestamp(),
    })
    return keyed if "position" in records.columns else keyed.withColumn("position", F.struct("source", "ordinal"))


def first_copies(observations: DataFrame) -> DataFrame:
    """First copy of every event key.  Copies collapse map-side, so a key with very many copies is cheap."""
    kept = F.struct("raw", "sha256")
    return observations.groupBy("eventKey").agg(F.min_by(kept, "position").alias("_first"), F.min("position").alias("position")) \
        .select("eventKey", "position", "_first.raw", F.col("_first.sha256").alias("evidenceHash"))


def assign_seq(first: DataFrame, offset: int = 0, folder: str | None = None) -> DataFrame:
    """Number events by (eventTime text, eventKey), missing times last."""
    return number_rows(first, [F.col("eventTime").asc_nulls_last(), F.col("eventKey").asc()], "seq", offset, folder=folder)


def _first_places(observations: DataFrame) -> DataFrame:
    """Where the first copy of every key lies, and its time: narrow rows, collapsed map-side.

    A written observation is found by its number alone; where it came from only tells which copy is the first.
    """
    time = F.from_json("raw", "eventTime string")["eventTime"].alias("eventTime")
    if _ROW in observations.columns:
        first = F.min(F.struct("position", F.unhex("sha256"), _ROW, time))  # a hash as bytes has the order of its digits
        return observations.groupBy("eventKey").agg(first.alias("_first")).select("eventKey", f"_first.{_ROW}", "_first.eventTime")
    return observations.groupBy("eventKey").agg(F.min(F.struct("position", "sha256", time)).alias("_first")).select("eventKey", "_first.*")


def new_events(observations: DataFrame, stored: DataFrame | None = None, offset: int = 0, known: DataFrame | None = None,
               folder: str | None = None) -> DataFrame:
    """Event rows a batch adds: first copies of keys not stored yet, extracted and numbered.

    Known keys (``known``, or those of the batch that ``stored`` holds) fall out first.  Only narrow rows are collapsed,
    sorted and numbered; the text of a record moves once, to meet the number of its place, and only new events are
    parsed.  The join is by place, not by key, so the copies of one key do not meet.  With a scratch ``folder`` the
    narrow rows are stored there, and the result holds as long as the folder.
    """
    firsts = _first_places(observations)
    if stored is not None:
        known = stored.select("eventKey").join(observations.select("eventKey"), "eventKey", "left_semi")
    if known is not None:
        firsts = firsts.join(known, "eventKey", "left_anti")
    numbered = assign_seq(firsts, offset, folder)
    if _ROW in firsts.columns:
        placed = observations.filter("position IS NOT NULL AND sha256 IS NOT NULL AND eventKey IS NOT NULL")
        rows = placed.select(_ROW, "eventKey", "sha256", "raw").join(numbered.select(_ROW, "seq"), _ROW)
    else:
        place = [c for c in firsts.columns if c != "eventTime"]
        rows = observations.select(*place, "raw").join(numbered.select(*place, "seq"), place)
        rows = rows.dropDuplicates(place)  # the same record may be listed twice at one place
    return with_facts(extract_events(rows.withColumnRenamed("sha256", "evidenceHash"))
                      .select("seq", *EVENT_COLUMNS, "raw", "eventKey", "evidenceHash"))


# --- dataset on storage ---------------------------------------------------------
# <dir>/state/<version> describes a commit: generation, parts of the tables, runs of the key index.  A version is created
# once and everything it names is immutable Parquet, so readers never see half an import, and of two writers that started
# from the same version one is refused.

#: Names of batches kept in the state; when there are more, they move into the key index.
NAMES = 1000
#: Parts with fewer events than this are joined by ``compact_dataset``.
SMALL_PART = 1 << 20


def state_folder(out_dir: str) -> str:
    return f"{out_dir}/state"


def _state(spark: SparkSession, out_dir: str) -> dict | None:
    versions = names_in(spark, state_folder(out_dir))
    return json.loads(read_text(spark, f"{state_folder(out_dir)}/{versions[-1]}")) if versions else None


def _commit(spark: SparkSession, out_dir: str, state: dict, begun: dict | None) -> Snapshot:
    """Publish ``state``, which was made from ``begun``, as the next version.  Whoever comes second is refused."""
    state = {**state, "version": (begun or {"version": 0})["version"] + 1}
    if not create_text(spark, f"{state_folder(out_dir)}/{state['version']:012d}", json.dumps(state)):
        raise RuntimeError(f"another writer has published version {state['version']} of {out_dir}; nothing was changed")
    return Snapshot(state["generation"], state["max_seq"], datetime.datetime.now(datetime.timezone.utc).isoformat())


def _empty_state() -> dict:
    return {"generation": f"gen-{uuid.uuid4().hex}", "parts": [], "names": [], "folded": False, "keys": [], "max_seq": 0}


def _part_paths(home: str, table: str, parts: list[dict]) -> list[str]:
    return [f"{home}/{table}/part={p['dir']}" for p in parts if p[table]]


def _read_parts(spark: SparkSession, home: str, table: str, parts: list[dict]) -> DataFrame:
    """One scan over all parts; the date folders are a column, as they are in each part."""
    return spark.read.option("basePath", f"{home}/{table}").parquet(*_part_paths(home, table, parts)).drop("part")


def _unrepeated(observed: DataFrame) -> DataFrame:
    """Observations as they are written: an original that is the record itself is left out.  One that is missing has no hash."""
    return observed.withColumn("original", F.when(F.col("original") == F.col("raw"), None).otherwise(F.col("original")))


def _repeated(written: DataFrame) -> DataFrame:
    """Written observations with every original."""
    return written.withColumn("original", F.when(F.col("original").isNull() & F.col("sha256").isNotNull(), F.col("raw")).otherwise(F.col("original")))


def _write_batch(records: DataFrame, out_dir: str, state: dict, batch: str) -> bool:
    """Write a batch beside the committed ones and note it in ``state``; False when it has no records.

    The records are read once, into the batch's observations; what was written is then checked and published.
    """
    spark, home, part = records.sparkSession, f"{out_dir}/{state['generation']}", {"dir": f"p-{uuid.uuid4().hex}"}
    identity = F.sha2(F.concat_ws("\u0001", F.lit(state["generation"]), F.lit(batch), "source", F.col("ordinal").cast("string")), 256)
    observed = observations_of(records).withColumns({"observationId": identity, _ROW: F.monotonically_increasing_id()})
    path = f"{home}/observations/part={part['dir']}"
    with freed_shuffles(spark):
        _unrepeated(observed).withColumn("eventDate", F.to_date("observedAt")).write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(observed.schema).parquet(path)
    first = invalid_records(saved).select("source", "ordinal").first()
    if first is not None:
        raise ValueError(f"invalid audit record from {first['source']} at {first['ordinal']}; nothing was published")
    part["observations"] = saved.count()
    if not part["observations"]:
        return False
    with scratch(spark) as folder, freed_shuffles(spark):
        known = keyindex.known(saved, home, state["keys"])
        events = new_events(saved, None, state["max_seq"], known, folder).withColumn("eventDate", F.to_date("ts"))
        events.write.partitionBy("eventDate").option("compression", "zstd").parquet(f"{home}/events/part={part['dir']}")
    fields = T.StructType([f for f in events.schema if f.name != "eventDate"])
    written = spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(f"{home}/events/part={part['dir']}")
    part["events"], top = written.agg(F.count(F.lit(1)), F.max("seq")).first()
    if part["events"]:
        with freed_shuffles(spark):
            state["keys"] = keyindex.merged(spark, home, [*state["keys"], keyindex.write_run(written, home, part["events"])])
        state["max_seq"] = top
    part["last_seq"] = state["max_seq"]
    state["parts"].append(part)
    state["names"].append(batch)
    if len(state["names"]) > NAMES:
        names = small_table(spark, [(_BATCH_KEY + n,) for n in state["names"]], "eventKey string")
        state["keys"] = keyindex.merged(spark, home, [*state["keys"], keyindex.write_run(names, home, len(state["names"]))])
        state["names"], state["folded"] = [], True
    return True


def _is_written(spark: SparkSession, out_dir: str, state: dict, batch: str) -> bool:
    if batch in state["names"] or not state["folded"]:
        return batch in state["names"]
    found = keyindex.known(small_table(spark, [(_BATCH_KEY + batch,)], "eventKey string"), f"{out_dir}/{state['generation']}", state["keys"])
    return not found.isEmpty()


def import_dataset(records: DataFrame, out_dir: str) -> Snapshot:
    """Replace the dataset: all records or none.  An input without records is an error."""
    spark = records.sparkSession
    begun, state = _state(spark, out_dir), _empty_state()
    if not _write_batch(records, out_dir, state, "batch-0"):
        raise ValueError("the input holds no audit records")
    return _commit(spark, out_dir, state, begun)


def append_events(records: DataFrame, out_dir: str, batch: str | None = None) -> Snapshot:
    """Add a batch; known event keys only add observations.  A batch name makes retries harmless."""
    spark = records.sparkSession
    begun = _state(spark, out_dir)
    state = json.loads(json.dumps(begun)) or _empty_state()
    batch = batch or f"batch-{uuid.uuid4().hex}"
    if not _is_written(spark, out_dir, state, batch) and _write_batch(records, out_dir, state, batch):
        return _commit(spark, out_dir, state, begun)
    return Snapshot(state["generation"], state["max_seq"])


def compact_dataset(spark: SparkSession, out_dir: str, small: int = SMALL_PART) -> int:
    """Write the parts with fewer than ``small`` events as one; returns how many there were.  Numbers and rows stay."""
    begun = _state(spark, out_dir)
    if begun is None:
        raise ValueError(f"no dataset at {out_dir}")
    few = [p for p in begun["parts"] if p["events"] < small]
    if len(few) < 2:
        return 0
    home, part = f"{out_dir}/{begun['generation']}", {"dir": f"p-{uuid.uuid4().hex}", "last_seq": max(p["last_seq"] for p in few)}
    for table, dates in (("events", ["eventDate"]), ("observations", [])):
        part[table] = sum(p[table] for p in few)
        if part[table]:
            _read_parts(spark, home, table, few).write.partitionBy(*dates).option("compression", "zstd").parquet(f"{home}/{table}/part={part['dir']}")
    _commit(spark, out_dir, {**begun, "parts": [*[p for p in begun["parts"] if p not in few], part]}, begun)
    return len(few)


def open_dataset(spark: SparkSession, out_dir: str, snapshot: Snapshot | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, observations) of the committed batches; a snapshot of a replaced generation is refused."""
    state = _state(spark, out_dir)
    if state is None:
        raise ValueError(f"no dataset at {out_dir}")
    if snapshot is not None and snapshot.generation != state["generation"]:
        raise ValueError("the dataset was replaced; start a new search")
    events, observations = (_read_parts(spark, f"{out_dir}/{state['generation']}", table, state["parts"]) for table in ("events", "observations"))
    return (events if snapshot is None else snapshot.of(events)), _repeated(observations).drop(_ROW)


def committed_after(spark: SparkSession, out_dir: str, version: int, seq: int) -> tuple[DataFrame | None, dict]:
    """Events of a committed version that were numbered after ``seq`` (None: none), and its state; older parts are not opened."""
    state = json.loads(read_text(spark, f"{state_folder(out_dir)}/{version:012d}"))
    parts = [p for p in state["parts"] if p["events"] and p["last_seq"] > seq]
    return (_read_parts(spark, f"{out_dir}/{state['generation']}", "events", parts).filter(F.col("seq") > seq) if parts else None), state


# --- evidence ---------------------------------------------------------------------

def evidence_stats(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Counts of events, observations, events with differing copies, lossy copies; one shuffle of narrow rows."""
    per_key = observations.groupBy("eventKey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lossy").alias("lossy"), (F.min("sha256") != F.max("sha256")).alias("differs"))
    total = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count_if("differs").alias("variantEvents"),
                       F.coalesce(F.sum("lossy"), F.lit(0)).alias("lossy")).withColumn("events", total)


def evidence_pages(events: DataFrame, observations: DataFrame, page_size: int = EVIDENCE_PAGE, page: int = 0) -> DataFrame:
    """One page of source copies of every event, with totals per event."""
    sizes = observations.groupBy("eventKey").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("sha256").alias("variants"))
    keys = events.select("seq", "eventKey", "evidenceHash")
    listed = top_rows(observations.select("eventKey", "position", "sha256", "source", "ordinal", "format", "lossy"),
                      ["eventKey"], [F.col("position").asc()], page_size * (page + 1)).filter(F.col("rank") > page_size * page)
    return listed.join(keys, "eventKey").join(sizes, "eventKey").withColumn("displayed", F.col("sha256") == F.col("evidenceHash"))


def lookup(table: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows for a request list (``position``, key) in request order; ``found`` marks the missing ones."""
    hit = table.withColumn("found", F.lit(True))
    return wanted.join(hit, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def require_all(found: DataFrame) -> DataFrame:
    """Fail when a requested row is missing (one small action)."""
    with freed_shuffles(found.sparkSession):
        if not found.filter(~F.col("found")).isEmpty():
            raise ValueError("not every record that was asked for is stored")
    return found


def by_parsed_time(events: DataFrame, position: Column | str = "position") -> DataFrame:
    """Text-dump order: parsed time, unusable times last, input order among equals."""
    return events.orderBy(F.col("ts").asc_nulls_last(), position)


def dump_places(events: DataFrame, position: str = "position", name: str = "place") -> DataFrame:
    """Text-dump order as numbers from 1, for dumps too large to be sorted as a whole: (position, place)."""
    return number_rows(events.select("ts", position), [F.col("ts").asc_nulls_last(), F.col(position).asc()], name).select(position, name)
