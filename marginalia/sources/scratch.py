"""Where intermediate tables may go."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a plain local master a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="marginalia-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def place(spark: SparkSession, path: str):
    """A path in whatever store it names, as Spark's file system and path objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = place(spark, path)
    return store.exists(at)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all, over one of the same name."""
    store, at = place(spark, path)
    new = place(spark, f"{path}.{uuid.uuid4().hex}.new")[1]
    out = store.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(at):
        store.delete(at, False)
    if not store.rename(new, at):
        store.delete(new, False)
        raise OSError(f"{path} could not be written")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files go when the application's file system handle closes."""
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    store, at = place(spark, path)
    store.deleteOnExit(at)
    return path


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files as they end; else those stay until the driver's JVM happens to collect what refers to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def removed(spark: SparkSession, path: str) -> Iterator[None]:
    """Delete what has been written at ``path`` within, in whatever way it ends."""
    try:
        yield
    finally:
        store, at = place(spark, path)
        store.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, and go when the application's file system handle closes.
    """
    path = fresh(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
