"""Consecutive numbers over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint, put_aside


ROWS_PER_PARTITION = 1 << 20
SMALL_PARTITION = 1 << 13


def _partitions(spark, rows: int) -> int:
    """As many as the rows need, and enough for all cores as long as they are worth a task."""
    return max(1, -(-rows // ROWS_PER_PARTITION), min(spark.sparkContext.defaultParallelism, rows // SMALL_PARTITION))


def number_rows(df: DataFrame, order: list[Column], name: str = "seq", offset: int = 0, partitions: int | None = None,
                rows: int | None = None, folder: str | None = None) -> DataFrame:
    """Add ``offset + row_number() over (order by ...)``.

    Rows are range-partitioned and sorted; each task numbers its own rows and the sizes of the earlier partitions are
    added by a join with one row per partition.  The rows are checkpointed before, so that they are counted and sampled
    without being made again and the number of partitions follows their number, and after, so that sizes and numbers
    come from one and the same partitioning.  A caller who has stored ``df`` and knows its number of ``rows`` says so.
    With a scratch ``folder`` they are stored there, packed, and the result holds as long as the folder.
    """
    stored = checkpoint if folder is None else (lambda kept: put_aside(kept, folder))
    if partitions is None and rows is None:
        df = stored(df)
        rows = df.count()
    partitions = partitions or _partitions(df.sparkSession, rows)
    local = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order) \
        .withColumn("_part", F.shiftright(local, 33)).withColumn("_row", local.bitwiseAND((1 << 33) - 1))
    ranged = stored(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # one row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part") \
        .withColumn(name, F.col("_start") + F.col("_row") + 1 + offset).drop("_part", "_row", "_start")
