"""Time slices: split one key's long history without losing order.

A key that owns a large share of all rows would be one window partition.  When
an operator only looks back a bounded time, its rows can be cut into slices that
carry a look-back overlap; work per task is then bounded by slice length instead
of by key size, and results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SLICE_FACTOR = 4


def with_slices(rows: DataFrame, ms: str, look_back_ms: int, slice_name: str = "slice", own_name: str = "own",
                carry: Column | None = None, factor: int = SLICE_FACTOR) -> DataFrame:
    """Assign rows to their own slice and, within the look-back, to the next one.

    Slices are ``factor`` look-backs long, so about 1/factor of the rows are
    copied.  ``carry`` limits copies to rows that can matter to a later slice.
    """
    length = look_back_ms * factor
    own = F.floor(F.col(ms) / length)
    late = (own + 1) * length - F.col(ms) <= look_back_ms
    copied = late if carry is None else late & carry
    slices = F.when(copied, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_own", own).withColumn(slice_name, F.explode(slices)) \
        .withColumn(own_name, F.col(slice_name) == F.col("_own")).drop("_own")
