"""Events made from records written in a test."""

import json

from pyspark.sql import functions as F

from auditspark.functions.labels import content_key
from auditspark.functions.records import extract_events
from auditspark.session import small_table


def make_events(spark, records):
    """Events from dict records; seq follows list order unless given as ``_seq``."""
    rows = [(r.get("_seq", i + 1), json.dumps({k: v for k, v in r.items() if k != "_seq"})) for i, r in enumerate(records)]
    events = extract_events(small_table(spark, rows, "seq bigint, raw string"))
    return events.withColumn("eventKey", content_key(F.col("recipientAccountId"), F.col("eventID"), F.col("raw"))) \
        .withColumn("evidenceHash", F.sha2("raw", 256))
