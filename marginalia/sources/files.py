"""Files below a folder: their digests, whatever their size, and paths that must stay below it."""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import safe_path

#: Larger files are hashed as they stream by; in stores that only Spark reaches, a binary column's own limit.
WHOLE, WHOLE_ELSEWHERE, BLOCK = 64 << 20, (1 << 31) - 1, 1 << 20
_SCHEME = "^(file:/*|[a-zA-Z][a-zA-Z0-9+.-]+:)"


def _qualified(spark: SparkSession, root: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, _SCHEME, "/")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, file, length, content`` of all files below a folder; ``file`` is relative to it. Contents are read only where asked for."""
    base = re.sub(_SCHEME, "/", _qualified(spark, root)) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.substring(_bare(F.col("path")), F.lit(len(base) + 1), F.length("path")).alias("file"), "length", "content")


def digests(spark: SparkSession, root: str, whole: int | None = None) -> DataFrame:
    """``file, length, sha256`` of all files below a folder, each read once.

    Files of at most ``whole`` bytes are hashed by Spark's own function; larger ones by the workers, a block at a
    time, from any store that Arrow reaches. Files without a byte are not listed. A file whose path leads out of the
    folder by a link raises.
    """
    local = _qualified(spark, root).startswith("file:")
    whole = whole or (WHOLE if local else WHOLE_ELSEWHERE)
    files = listed(spark, root)
    if local:
        require_inside(files.select("path"), root)
    small = files.where(F.col("length") <= whole).select("file", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                store, at = (pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(path)
                running = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while block := stream.read(BLOCK):
                        running.update(block)
                found.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("length"), pa.array(found, pa.string())], ["file", "length", "sha256"])

    large = files.where(F.col("length") > whole).select("path", "file", "length")
    return small.unionByName(large.mapInArrow(run, "file string, length long, sha256 string"))


def require_inside(paths: DataFrame, root: str) -> None:
    """Raise unless all local files lie below ``root`` when links are followed."""
    true_root = os.path.realpath(re.sub("^file:(//)?", "", root))
    below = F.udf(lambda path: os.path.commonpath([true_root, os.path.realpath(re.sub("^file:/*", "/", path))]) == true_root, "boolean")  # a row a file
    if wrong := paths.where(~below("path")).limit(5).collect():
        raise ValueError("a link leads out of the folder: " + ", ".join(r["path"] for r in wrong))


def resolved(rows: DataFrame, found: DataFrame, column: str = "video") -> DataFrame:
    """``rows`` with their file's ``sha256``; a path that is not safe, or has no file in ``found`` (``digests``), raises."""
    met = rows.join(found.select(F.col("file").alias(column), F.col("sha256").alias("found_sha256")), column, "left")
    missing = F.raise_error(F.concat(F.lit("missing or outside the folder: "), F.coalesce(F.col(column), F.lit("null"))))
    digest = F.when(safe_path(F.col(column)) & F.col("found_sha256").isNotNull(), F.col("found_sha256")).otherwise(missing)
    return met.select(*rows.columns, digest.cast("string").alias("file_sha256"))
