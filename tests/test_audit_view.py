"""The stored events: even tasks whatever the layout of the source, and facts from one parse."""

import json

from pyspark.sql import functions as F

from auditspark.functions.facts import with_facts
from auditspark.session import small_table
from auditspark.sources import audit_view
from auditspark.sources.files import spread


def test_rows_of_a_task_are_bounded_however_few_files_there_are(spark, tmp_path):
    spark.range(0, 5000, numPartitions=1).write.parquet(str(tmp_path / "t"))
    spread_rows = spread(spark.read.parquet(str(tmp_path / "t")), 500)
    sizes = [r["count"] for r in spread_rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) <= 550


def test_facts_keep_what_odd_members_hold(spark):
    arn = "arn:aws:s3:::b"
    texts = [json.dumps({"sharedEventID": "s", "requestID": "r", "readOnly": True, "resources": [{"ARN": arn, "type": "T"}, 7, {"ARN": "x"}],
                         "requestParameters": {"a": arn, "b": {"c": 1}, "d": None}}), '{"readOnly":"true","requestParameters":7}', "{", None]
    rows = with_facts(small_table(spark, list(enumerate(texts)), "n int, raw string")).orderBy("n").select("facts.*").collect()
    assert [(r["recordedReadOnly"], r["sharedID"], r["requestID"]) for r in rows[:2]] == [(True, "s", "r"), (None, None, None)]
    assert [tuple(ref) for ref in rows[0]["refs"]] == [(arn, "T", "resources[0].ARN"), (arn, "Request reference", 'requestParameters["a"]')]
    assert [r["refs"] for r in rows[1:]] == [[], [], []]
    assert all(r["hasContext"] is False for r in rows)


def test_tasks_that_import_stay_small(spark, tmp_path):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("view", "click", "purchase", "signup", "error")]), (F.col("id") % 5 + 1).cast("int"))
    spark.range(0, 90_000, numPartitions=1).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), (F.col("id") % 50).alias("user_id"),
                                                   kind.alias("event_type"), F.lit('{"k": 1}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    sizes = [r["count"] for r in audit_view.project_events(spark, str(tmp_path)).filter("copy = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90_000 and max(sizes) <= 20_500
