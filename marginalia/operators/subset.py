"""Deterministic subsets and pending work."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import json_text, subset_key

PIECE = 1 << 16


def subset(df: DataFrame, limit: int, seed: int) -> DataFrame:
    """The first ``limit`` rows by hash of seed and id, whatever order they come in; 0 means all."""
    ordered = df.orderBy(subset_key(F.col("id"), seed), "id")
    return ordered.limit(limit) if limit else ordered


def subset_digest(df: DataFrame) -> DataFrame:
    """``ids_sha256, n`` of a subset: the SHA-256 of the JSON list of its sorted ids, and how many rows it has.

    Ids are sorted and written as text in ranges, on all executors; one task hashes the pieces of text in their
    order as they stream by, so that none holds more than a few batches, however many ids there are.
    """
    ids = df.select("id", json_text(F.col("id")).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    pieces = ids.mapInArrow(_pieces, "part int, seq long, n long, text binary")
    start = df.sparkSession.range(1).selectExpr("-1 AS part", "0L AS seq", "0L AS n", "CAST(NULL AS BINARY) AS text")  # there with no ids too
    return pieces.union(start).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_hashed, "ids_sha256 string, n long")


def _pieces(batches):
    """The texts of a range, joined into pieces of about ``PIECE`` bytes."""
    part, seq, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([n]), pa.array([", ".join(held).encode()], pa.binary())], ["part", "seq", "n", "text"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            n += 1
            if text is not None:
                held.append(text)
                size += len(text)
            if size >= PIECE:
                yield piece()
                seq, held, n, size = seq + 1, [], 0, 0
    if n:
        yield piece()


def _hashed(batches):
    running, first, n = hashlib.sha256(b"["), True, 0
    for batch in batches:
        n += sum(batch.column("n").to_pylist())
        for text in batch.column("text").to_pylist():
            if text:
                running.update(text if first else b", " + text)
                first = False
    running.update(b"]")
    yield pa.RecordBatch.from_arrays([pa.array([running.hexdigest()]), pa.array([n], pa.int64())], ["ids_sha256", "n"])


def pending(selected: DataFrame, done: DataFrame, limit: int = 0, ordered: bool = True) -> DataFrame:
    """Rows without a committed result, in order of video, start and id; at most ``limit`` if given."""
    rest = selected.join(done.select("id"), "id", "left_anti").select(*selected.columns)
    rest = rest.orderBy("video", "start", "id") if ordered else rest
    return rest.limit(limit) if limit else rest
