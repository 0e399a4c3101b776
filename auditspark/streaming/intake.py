"""Live intake: queue messages to the dataset, exactly once per event key."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.labels import content_key
from ..operators.hunts import match_sequence
from ..operators.maintain import append_events, committed_after, state_folder
from ..session import checkpoint, freed_shuffles, put_aside, scratch
from ..sources.pointer import read_text
from ..sources.readers import open_envelopes

# Envelope types of a capture scope.
ALL_MANAGEMENT = ("AWS API Call via CloudTrail", "AWS Console Sign In via CloudTrail", "AWS Console Signin via CloudTrail",
                  "AWS Console Action via CloudTrail", "AWS Service Event via CloudTrail")
WRITE_ONLY = ALL_MANAGEMENT[:1]
#: Most hashes of repeated texts of a batch that every task is told.
FEW_COPIES = 1 << 14


def capture_scope(messages: DataFrame, write_only: bool = False, extra: Column | None = None, column: str = "value") -> DataFrame:
    """Management events of the accepted envelope types, optionally writes only; ``extra`` is ANDed."""
    envelope = F.from_json(F.col(column), "`detail-type` string, detail struct<eventCategory:string,readOnly:boolean>")
    kept = messages.withColumn("_e", envelope).filter(
        F.col("_e").getField("detail-type").isin(*(WRITE_ONLY if write_only else ALL_MANAGEMENT)) & (F.col("_e.detail.eventCategory") == "Management"))
    if write_only:
        kept = kept.filter(~F.col("_e.detail.readOnly"))
    return (kept if extra is None else kept.filter(extra)).drop("_e")


def batch_records(records: DataFrame, source: str) -> DataFrame:
    """Message bodies as records; the order inside a batch is the record text, so a retry repeats it.

    Equal texts of a batch are numbered, so that each keeps an ordinal of its own.  Hashes tell which texts may be equal;
    while they are few, the other texts stay where they are.
    """
    hashed = records.withColumn("_hash", F.xxhash64("raw"))
    with freed_shuffles(records.sparkSession):
        again = checkpoint(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"))
        some = again.limit(FEW_COPIES + 1).count()
    copy = F.row_number().over(Window.partitionBy("_hash").orderBy("raw"))
    if some > FEW_COPIES:
        numbered = hashed.withColumn("_copy", copy)
    else:
        numbered = hashed.join(F.broadcast(again), "_hash", "left_anti").withColumn("_copy", F.lit(1))
        if some:
            numbered = numbered.unionByName(hashed.join(F.broadcast(again), "_hash", "left_semi").withColumn("_copy", copy))
    return numbered.select(
        "raw", F.col("raw").alias("original"), F.lit(source).alias("source"), F.xxhash64("raw", "_copy").alias("ordinal"),
        F.lit("live").alias("format"), F.lit(False).alias("lossy"), F.lit(None).cast("string").alias("error"))


def _batch_name(source: str, stream: str, batch_id: int) -> str:
    return f"live-{source}-{stream}-{batch_id}"


def intake_batch(messages: DataFrame, batch_id: int, out_dir: str, rejects_dir: str, source: str = "live", stream: str = "") -> None:
    """Body of ``foreachBatch``: commit the records, set other messages aside; repeating it changes nothing.

    ``stream`` is the query's id: batches of another query, or of one whose progress was lost, have other names.
    """
    name = _batch_name(source, stream, batch_id)
    with scratch(messages.sparkSession) as folder:
        opened = messages if "raw" in messages.columns else open_envelopes(messages)
        opened = put_aside(opened.select("raw", F.when(F.col("raw").isNull(), F.col("value")).alias("value")), folder)
        opened.filter("raw IS NULL").select("value").write.mode("overwrite").option("compression", "zstd").parquet(f"{rejects_dir}/{name}")
        append_events(batch_records(opened.filter("raw IS NOT NULL"), source), out_dir, name)


def reject_counts(spark, rejects_dir: str) -> DataFrame:
    """(batch, rejects): how many messages of each batch were set aside, counted from the stored ones."""
    batch = F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1)
    return spark.read.parquet(f"{rejects_dir}/*").groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("rejects"))


class IntakeCounts(StreamingQueryListener):
    """Messages and rejects of every batch, taken from the metrics that the batch observed while it ran.

    ``counts`` maps (query id, batch) to (messages, rejects), ``state_rows`` to the keys that the state held.  Register it
    with ``spark.streams.addListener``; events come a little after the batch, so ``finished`` waits for the last one.
    """

    NAME = "intake"

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], tuple[int, int]] = {}
        self.state_rows: dict[tuple[str, int], int] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.NAME)
        if seen is not None and seen["messages"]:
            self.counts[str(progress.id), progress.batchId] = (seen["messages"], seen["rejects"])
        if progress.stateOperators:
            self.state_rows[str(progress.id), progress.batchId] = sum(o.numRowsTotal for o in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def finished(self, query: StreamingQuery, seconds: float = 60) -> IntakeCounts:
        """Wait until the events of a stopped query are here."""
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the listener got no end of the query")
        return self


def _query_id(spark, checkpoint_dir: str) -> str:
    """Id of the query whose progress is kept in a folder."""
    return json.loads(read_text(spark, f"{checkpoint_dir}/metadata"))["id"]


def without_redelivered(opened: DataFrame, within: str, arrival: Column | None = None) -> DataFrame:
    """Opened messages without those delivered again inside a span: keyed state, bounded by a watermark over the arrival.

    A message that comes later than ``within`` behind the newest arrival is dropped as late, as its key is forgotten; so
    the span has to cover the delays of the queue.  The key is the event key, for rejects the message text.
    """
    key = F.coalesce(content_key(F.get_json_object("raw", "$.recipientAccountId"), F.get_json_object("raw", "$.eventID"), F.col("raw")), F.sha2("value", 256))
    keyed = opened.withColumns({"_arrival": F.current_timestamp() if arrival is None else arrival, "_key": key})
    return keyed.withWatermark("_arrival", within).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_arrival")


def start_intake(messages: DataFrame, out_dir: str, rejects_dir: str, checkpoint_dir: str, source: str = "live", within: str | None = None,
                 arrival: Column | None = None, write_only: bool | None = None, **trigger: Any) -> StreamingQuery:
    """Run the intake of a streaming frame with a ``value`` column.

    Progress is recorded after the dataset commit; a batch that is repeated after a failure is recognised by its name.
    ``within`` drops messages delivered again in that span before the batch looks its keys up (no observation is added
    for them); ``write_only`` restricts the intake to a capture scope.  An ``IntakeCounts`` listener gets the counts.
    """
    def each(df: DataFrame, n: int) -> None:
        intake_batch(df, n, out_dir, rejects_dir, source, _query_id(df.sparkSession, checkpoint_dir))

    opened = open_envelopes(messages if write_only is None else capture_scope(messages, write_only))
    opened = opened.observe(IntakeCounts.NAME, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("raw").isNull()).alias("rejects"))
    opened = opened.withColumn("value", F.when(F.col("raw").isNull(), F.col("value")))  # the message moves on for rejects only
    if within is not None:
        opened = without_redelivered(opened, within, arrival)
    writer = opened.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def follow_dataset(spark, out_dir: str, each: Callable[[DataFrame, int], None], checkpoint_dir: str, matches: Column | None = None,
                   **trigger: Any) -> StreamingQuery:
    """Give ``each`` the committed events that match, once per commit: (new events, version).

    The stream reads the folder of commits, where a version appears in one step, so a batch that failed or is still
    being written is never seen; events are told apart by their numbers, so neither is one given twice when parts are
    compacted.  A replaced dataset starts from its first event.  The place reached is the stream's progress: after a
    restart the commits go on where they stopped, and a batch cut off in between is given again.
    """
    def given(commits: DataFrame, _: int) -> None:
        session = commits.sparkSession
        states = sorted((json.loads(r["value"]) for r in commits.collect()), key=lambda s: s["version"])  # some commits, a line each
        for state in states:
            version = state["version"]
            before = json.loads(read_text(session, f"{state_folder(out_dir)}/{version - 1:012d}")) if version > 1 else {"generation": None, "max_seq": 0}
            reached = before["max_seq"] if before["generation"] == state["generation"] else 0
            events, _state = committed_after(session, out_dir, version, reached)
            if events is not None:
                each(events if matches is None else events.filter(matches), version)

    writer = spark.readStream.text(state_folder(out_dir)).writeStream.foreachBatch(given).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def affected_sequences(events: DataFrame, batch: DataFrame, steps: list, group: str = "principal", minutes: int = 60) -> DataFrame:
    """Sequences of the identities a late batch touched, recomputed by recorded time."""
    touched = batch.filter(F.coalesce("identityArn", F.lit("")) != "").select("identityArn").distinct()
    return match_sequence(events.join(touched, "identityArn", "left_semi"), steps, group, minutes)
