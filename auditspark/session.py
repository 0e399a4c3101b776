"""Session helpers: a local builder for tests and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "auditspark") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-held rows as a local relation: Spark knows its exact size when it picks a join."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=fields.names), fields)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where nobody set it (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditspark-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the execution that made them ends, not when the driver happens to collect its garbage.

    For frames that are executed once: one that is executed again has to make its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of what has ended and is not referred to any more, as of a stream's batches."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder for what is stored while a step runs; it is removed with the step."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def put_aside(df: DataFrame, folder: str) -> DataFrame:
    """The rows of ``df``, stored below a scratch folder as packed columns: a checkpoint keeps whole rows as they are."""
    spark, path = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` reliably: its rows survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
