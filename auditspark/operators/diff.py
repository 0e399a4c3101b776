"""Field-level views of records: display rows, presence profile, version differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.flatten import changed_members, flatten_records, path_counts

PREVIEW, CHANGE_LIMIT = 512, 500


def display_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """Typed field rows with a preview of at most 512 characters."""
    rows = flatten_records(records, keys)
    return rows.withColumns({"truncated": F.coalesce(F.length("value") > PREVIEW, F.lit(False)), "value": F.left("value", F.lit(PREVIEW))})


def field_profile(records: DataFrame) -> DataFrame:
    """Presence of every path: rows, distinct kinds, nulls, children; array positions are kept apart.

    Tasks count in trees of paths, so what is exchanged are paths and not members.
    """
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds"))))
    return path_counts(records).groupBy("path").agg(
        F.sum("rows").alias("rows"), F.array_join(kinds, ",").alias("kinds"), F.sum("nulls").alias("nulls"), F.sum("children").alias("children"))


def version_pairs(observations: DataFrame) -> DataFrame:
    """(pair, left, right): every differing copy of an event against its first copy.

    Each distinct text is paired once with the first copy, so a key with many
    copies yields as many pairs as it has versions.
    """
    differing = observations.groupBy("eventKey").agg((F.min("sha256") != F.max("sha256")).alias("differs")).filter("differs")
    copies = observations.join(differing.select("eventKey"), "eventKey", "left_semi")
    texts = copies.groupBy("eventKey", "sha256").agg(F.min("position").alias("position"), F.min_by("raw", "position").alias("raw"))
    first = texts.groupBy("eventKey").agg(F.min_by(F.struct("sha256", "raw"), "position").alias("f"))
    return texts.join(first, "eventKey").filter(F.col("sha256") != F.col("f.sha256")).select(
        F.concat_ws("#", "eventKey", "sha256").alias("pair"), F.col("f.raw").alias("left"), F.col("raw").alias("right"))


def diff_versions(pairs: DataFrame, limit: int | None = CHANGE_LIMIT) -> DataFrame:
    """Added, removed and changed paths of every pair; array positions count, member order does not.

    Both texts lie on one row, so they are compared there and only the changes leave it.  A change is listed at the
    highest differing member: below a member whose kind differs or that exists on one side only, nothing is listed.
    With ``limit`` the first paths of each pair are given, ``rank`` numbers them and ``complete`` tells whether these
    are all; without it all are given.  Values are whole; a page may cut them with ``previewed``.
    """
    columns = ("path", "change", "leftKind", "left", "rightKind", "right")
    schema = T.StructType([pairs.schema["pair"], *[T.StructField(c, T.StringType()) for c in columns],
                           T.StructField("rank", T.IntegerType()), T.StructField("complete", T.BooleanType())])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair, left, right in zip(batch["pair"], batch["left"], batch["right"]):
                found = sorted(changed_members(left, right))
                most = len(found) if limit is None else limit
                rows.extend((pair, *change, rank, len(found) <= most) for rank, change in enumerate(found[:most], 1))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    changes = pairs.select("pair", "left", "right").mapInPandas(compare, schema)
    return changes.drop("rank", "complete") if limit is None else changes


def previewed(changes: DataFrame, length: int = PREVIEW) -> DataFrame:
    """A display step: values of at most ``length`` characters, with ``leftTruncated`` and ``rightTruncated``."""
    return changes.withColumns({f"{s}Truncated": F.length(s) > length for s in ("left", "right")}).withColumns(
        {s: F.left(s, F.lit(length)) for s in ("left", "right")})
