"""Input layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has slots.

    One small unsplittable file would otherwise run as one task.  Real inputs
    have many splits and are left alone, without a shuffle.

    Splits are cut by bytes, but a row group is read by one task only; where much work is done per row, ``rows`` gives the
    rows of a task: the rows are dealt evenly to as many tasks as that makes, so that no task grows with the table.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        return df.repartition(max(slots, -(-df.count() // rows)))
    return df.repartition(slots) if df._jdf.rdd().getNumPartitions() < slots else df
