"""Small text files on any Hadoop file system: replaced in one step, or created once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it."""
    fs, target = _fs(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(draft, target, options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write beside the target and give it its name, unless the name is taken: then False, and nothing changes.

    Of several writers exactly one succeeds: a rename without overwriting is one step on a distributed file system, a
    hard link is one step on a local disk.
    """
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            names = [spark._jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)) for p in (target, draft)]
            spark._jvm.java.nio.file.Files.createLink(*names)
            fs.delete(draft, False)
        else:
            options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without drafts; none when there is no folder."""
    fs, target = _fs(spark, path)
    return sorted(name for f in fs.listStatus(target) if not (name := f.getPath().getName()).startswith(".")) if fs.exists(target) else []
