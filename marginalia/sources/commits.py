"""Tables of atomic commits in any store: batches of files, each made part of the table by one log entry.

A batch is written in a folder of its own that no reader looks at, its files are moved beside the table's, and one
entry, named by the batch, that lists them is created whole or not at all. Readers follow the entries. A writer that
stops anywhere leaves either the whole batch or nothing that is read; writing the batch again under its name
makes it part of the table once.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from marginalia.sources import scratch

#: Stores whose renames are atomic and never replace a file.
_RENAMING = ("hdfs", "viewfs", "webhdfs", "swebhdfs")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless there is one of the name; says whether it did."""
    store, at = scratch.place(spark, path)
    scheme = store.getScheme() if not re.match("file:|/", str(store.getUri())) else "file"
    if scheme != "file" and scheme not in _RENAMING:  # object stores: a file is seen when it is closed
        try:
            out = store.create(at, False)
            out.write(bytearray(text.encode()))
            out.close()
            return True
        except Exception:
            if store.exists(at):
                return False
            raise
    new = scratch.place(spark, f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.new")[1]
    out = store.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if scheme != "file":
            return bool(store.rename(new, at))
        local = lambda p: re.sub("^file:(//)?", "", str(p.toString()))
        try:
            os.link(local(new), local(at))  # fails if there is one already
            return True
        except FileExistsError:
            return False
    finally:
        store.delete(new, False)


class CommitLog:
    """A table of Parquet files in ``folder/data`` whose batches are entries of ``folder/<log>``."""

    def __init__(self, spark: SparkSession, data: str, log: str):
        self.spark, self.data, self.log = spark, str(data), str(log)

    def begun(self) -> bool:
        return scratch.exists(self.spark, f"{self.log}/begin.json")

    def begin(self) -> None:
        """From now on only the log's entries are read."""
        create_once(self.spark, f"{self.log}/begin.json", "[]")

    def has(self, batch: str) -> bool:
        return scratch.exists(self.spark, f"{self.log}/{batch}.json")

    def files(self) -> list[str]:
        """The files of all committed batches."""
        if not self.begun():
            return []
        entries = self.spark.read.text(f"{self.log}/*.json", wholetext=True).collect()  # names of files
        return sorted(f"{self.data}/{name}" for r in entries for name in json.loads(r[0]))

    def read(self, schema) -> DataFrame:
        found = self.files()
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Make ``rows`` part of the table as ``batch``; a batch that is there already is left as it is."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch's name: {batch}")
        if self.has(batch):
            return False
        if not self.begun():
            self.begin()
        attempt = f"{batch}-{uuid.uuid4().hex}"
        staged = f"{self.data}/_staged/{attempt}"
        try:
            rows.write.parquet(staged)
            names = self._move(staged, attempt)
            return self._publish(batch, names)
        finally:
            with contextlib.suppress(Exception):  # what stays is never read
                store, at = scratch.place(self.spark, staged)
                store.delete(at, True)

    def _move(self, staged: str, attempt: str) -> list[str]:
        """Give the staged files their names beside the table's."""
        store, at = scratch.place(self.spark, staged)
        names = []
        for status in store.listStatus(at):
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                names.append(f"{attempt}-{len(names):05d}.parquet")
                if not store.rename(status.getPath(), scratch.place(self.spark, f"{self.data}/{names[-1]}")[1]):
                    raise OSError(f"{name} of {attempt} could not be moved")
        return names

    def _publish(self, batch: str, names: list[str]) -> bool:
        if create_once(self.spark, f"{self.log}/{batch}.json", json.dumps(names)):
            return True
        for name in names:  # another writer was first
            store, at = scratch.place(self.spark, f"{self.data}/{name}")
            store.delete(at, False)
        return False
