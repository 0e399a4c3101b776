"""Shared parts of the text operators: stored tables, label samples, and vectorised words of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 18
#: Most bytes and rows of an Arrow batch.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Byte classes.  White space is \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by bytes: texts can be long, and Spark's default counts rows.

    The settings stay for the session, because Spark reads them when a lazy result is computed; they change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release_memory() -> None:
    """Give what a task no longer uses back to the system; a Python worker lives on and its free memory counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and Spark knows its size."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str, modulus: int):
    """crc32 of the document id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def label_sample(labels: DataFrame, column: str, most: int, modulus: int = 5) -> DataFrame:
    """At most ``most`` (doc_id, label) rows outside the held-out fold, the first by hash of the id.

    Ids with contradicting labels, and labels other than 0 and 1, are left out.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold("doc_id", modulus) != 0))
             .groupBy("doc_id").agg(F.min(column).alias("low"), F.max(column).alias("high")).filter("low = high"))
    return known.select("doc_id", F.col("low").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_shards(docs: DataFrame, labels: DataFrame, column: str, most: int, shards: int) -> DataFrame:
    """The sampled rows' texts with label and shard.  The sample has ``most`` rows at most, so it may be broadcast."""
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(label_sample(labels, column, most))
    return (docs.select("doc_id", "text").join(sample, "doc_id")
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label",
                    F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard")))


def summed(parts: DataFrame, dims: int) -> np.ndarray:
    """Sum of the vectors that tasks emitted in pieces (piece, values); the result has ``dims`` numbers, a model's size."""
    rows = parts.groupBy("piece").applyInPandas(_sum_piece, "piece int, values binary").collect()
    out = np.zeros(dims)
    for row in rows:
        values = np.frombuffer(row["values"], np.float64)
        out[row["piece"] * PIECE: row["piece"] * PIECE + len(values)] = values
    return out


PIECE = 1 << 13


def pieces(vector: np.ndarray) -> list[tuple[int, bytes]]:
    """A vector cut into rows for ``summed``; pieces of zeros are left out."""
    cut = [(k // PIECE, vector[k: k + PIECE].astype(np.float64)) for k in range(0, len(vector), PIECE)]
    return [(k, part.tobytes()) for k, part in cut if part.any()]


def _sum_piece(pdf):
    import pandas as pd
    total = np.sum([np.frombuffer(v, np.float64) for v in pdf["values"]], axis=0)
    return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "values": [total.tobytes()]})


def least_common(counts: DataFrame, count: str, most: int) -> int:
    """The least power of two that at most ``most`` rows reach (1: all do); no sort, no ranking in one task."""
    by_size = counts.groupBy(F.floor(F.log2(count)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()  # a row per power
    held = 0
    for r in sorted(by_size, key=lambda r: -r["k"]):
        held += r["n"]
        if held > most:
            return 2 << r["k"]
    return 1


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds): runs of whole texts of about ``most`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def spans(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each run of marked bytes; runs end where a text ends."""
    n = len(mask)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[bounds[bounds < n]] = False
    after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(bounds[1:], starts, "right")


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, from one running sum of byte * base**-position."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("inverse", _INVERSE, n + 1)[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power("base", _BASE, n + 1)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
