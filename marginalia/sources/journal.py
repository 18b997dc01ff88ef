"""Run folders: a contract, a Parquet journal of results, an event log, and exports.

A folder may be in any store that Spark writes to. On a local path one writer at a time is ensured by a file
lock, elsewhere by a lock file that only one can create (after a crash of its writer it must be deleted).
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import metrics
from marginalia.schema import EVENT, EXPORT
from marginalia.sources import scratch
from marginalia.sources.commits import CommitLog, create_once


def elsewhere(path: str | Path) -> bool:
    """Whether a path is in a store that Python's own files do not reach."""
    return bool(re.match("(?!file:)[a-zA-Z][a-zA-Z0-9+.-]+://", str(path)))


def atomic_json(path: str | Path, value: object) -> None:
    """Write a small JSON file whole or not at all; NaN and infinity raise."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False)
    if elsewhere(path):
        return scratch.write_whole(SparkSession.active(), str(path), text + "\n")
    path = local(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise


def local(path: str | Path) -> Path:
    return Path(re.sub("^file:(//)?", "", str(path)))


@contextlib.contextmanager
def lock(folder: str | Path) -> Iterator[None]:
    """Hold a run folder for one writer."""
    if elsewhere(folder):
        store, at = scratch.place(SparkSession.active(), f"{folder}/.lock")
        try:
            store.create(at, False).close()
        except Exception as error:
            raise RuntimeError(f"{folder} has a writer already") from error
        try:
            yield
        finally:
            store.delete(at, False)
        return
    local(folder).mkdir(parents=True, exist_ok=True)
    with open(local(folder) / ".lock", "a") as handle:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"{folder} has a writer already") from None
        try:
            yield
        finally:
            fcntl.flock(handle, fcntl.LOCK_UN)


class Journal:
    """Results by id, each committed once, under one contract."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.path, self.events_path = f"{folder}/results", f"{folder}/events"
        self.commits = CommitLog(spark, self.path, f"{folder}/commits")

    def open(self, contract: dict, resume: bool) -> None:
        """Start a run, or go on with one of the same contract."""
        at = f"{self.folder}/contract.json"
        if not scratch.exists(self.spark, at):
            if resume:
                raise FileNotFoundError("no run to resume")
            store, folder = scratch.place(self.spark, self.folder)
            store.mkdirs(folder)
            self.commits.begin()
            atomic_json(at, contract)
        elif not resume:
            raise FileExistsError(f"{self.folder} holds a run; resume it")
        elif self.contract() != json.loads(json.dumps(contract)):
            raise ValueError("the contract has changed: start a new run")

    def contract(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/contract.json", wholetext=True).first()[0])

    def results(self) -> DataFrame:
        """The rows of all commits (of a journal without a log, all its files)."""
        if self.commits.begun() or not scratch.exists(self.spark, self.path):
            return self.commits.read(self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def done(self) -> DataFrame:
        return self.results().select("id")

    def put(self, rows: DataFrame, batch: str | None = None, new: bool = False) -> bool:
        """Commit rows, as one batch; says whether it did.

        A batch whose name is committed already is left out, and so are rows whose id is, unless the caller
        knows that all ids are ``new``. So a repeated batch does no harm.
        """
        batch = batch or uuid.uuid4().hex
        if self.commits.has(batch):
            return False
        if not self.commits.begun() and scratch.exists(self.spark, self.path):
            self._adopt()
        if not new:
            rows = rows.join(self.done(), "id", "left_anti").dropDuplicates(["id"])
        return self.commits.commit(batch, rows.select(*self.schema.names))

    def _adopt(self) -> None:
        """Bring the files of a journal that was written without a log under one."""
        store, at = scratch.place(self.spark, self.path)
        names = [s.getPath().getName() for s in store.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        create_once(self.spark, f"{self.commits.log}/earlier.json", json.dumps(names))
        self.commits.begin()

    def event(self, name: str, **detail: object) -> None:
        row = [(name, json.dumps(detail, sort_keys=True, allow_nan=False))]
        self.spark.createDataFrame(row, EVENT).coalesce(1).write.mode("append").json(self.events_path)


def read_run(spark: SparkSession, folder: str, schema) -> tuple[dict, DataFrame]:
    """A run's contract and its results, read-only."""
    journal = Journal(spark, folder, schema)
    return journal.contract(), journal.results()


def export(folder: str, contract: dict, results: DataFrame) -> dict:
    """Summary as JSON, predictions as JSON lines and as CSV of fixed columns, in order of id."""
    summary = metrics.summary(results, contract)
    atomic_json(f"{folder}/summary.json", summary)
    ordered = results.orderBy("id")
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/predictions_jsonl")
    csv_shape(ordered).write.mode("overwrite").csv(f"{folder}/predictions_csv", header=True)
    return summary


def csv_shape(results: DataFrame) -> DataFrame:
    """The export's columns; truth values are written True and False."""
    words = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False").alias(c)
    return results.select(*[words(c) if c in ("correct", "refined") else F.col(c) for c in EXPORT])
