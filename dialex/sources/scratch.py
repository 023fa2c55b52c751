"""A place for tables that are written and read again: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own under `spark.checkpoint.dir`. Only a local session, as in tests, may leave that unset; it gets a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dialex-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/dialex-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """A table written and read again, for one that is small beside what it is made from and used several times."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any store that Spark writes to."""
    at, store = _at(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all that is in it; nothing happens where there is none."""
    at, store = _at(spark, path)
    store.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    at, store = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file beside its place and moves it there, so that readers see all of it or nothing. There
    must be none in the place yet."""
    at, store = _at(spark, path + ".tmp")
    out = store.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(at, _at(spark, path)[0]):
        raise OSError(f"{path}: can't be put in place")


def text_of(spark: SparkSession, path: str) -> str | None:
    """The content of a small text file, or None."""
    at, store = _at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
