"""Resumable sessions: a run's pending rows in bounded, committed steps."""

from __future__ import annotations

import contextlib
import hashlib
import platform
import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyspark
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marginalia.config import Config, fingerprint
from marginalia.operators.numbering import numbered
from marginalia.operators.subset import pending, subset, subset_digest
from marginalia.plans.inference import results
from marginalia.sources import journal, scratch
from marginalia.sources import manifest as manifests

COMPLETE, PARTIAL = 0, 75
MAX_SECONDS = 165_600.0


def contract(config: Config, manifest: DataFrame, selected: DataFrame) -> dict:
    """What must stay the same for a run to go on."""
    ids = subset_digest(selected).first()
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    # sums of the rows' hashes: one row from each task, whatever the order of the rows
    sums = manifest.select(F.sha2(F.to_json(F.struct(*manifest.columns)), 256).alias("h")).agg(F.count("*").alias("n"), *[part(k) for k in range(4)])
    every = sums.select(F.sha2(F.concat_ws(":", "n", *[f"s{k}" for k in range(4)]).cast("binary"), 256).alias("h")).first()
    return {
        "schema": 2, "config": config.contract(), "manifest_sha256": every["h"], "resolved_dtype": "float32", "selected_ids_hash": ids["ids_sha256"], "selected_count": ids["n"],
        "source_sha256": fingerprint(), "runtime": {"python": ".".join(platform.python_version_tuple()[:2]), "pyspark": pyspark.__version__},
    }


def steps(selected: DataFrame, done: DataFrame, size: int, most: int, path: str) -> tuple[int, DataFrame]:
    """How many rows wait, and the first ``most`` of them (0: all) in steps of ``size``, in order of video, start and id.

    Only ids and what orders them are sorted and numbered, once; then rows are written by step, so that a step reads its
    own rows and no others. As many files are written as the session has shuffle partitions, or one a step if those are
    more: few steps are then read and answered by all tasks.
    """
    keys = pending(selected.select("id", "video", "start"), done, ordered=False)
    placed = numbered(keys, "video", "start", "id", path=f"{path}/numbered")
    count = placed.count()
    some = placed.where(F.col("position") < most) if most else placed
    step = some.select("id", F.floor(F.col("position") / size).cast("long").alias("step"))
    number = max(1, -(-(min(count, most) if most else count) // size))
    share = F.pmod(F.xxhash64("id"), F.lit(-(-int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")) // number)))
    selected.join(step, "id").select(*selected.columns, "step").repartition("step", share).write.partitionBy("step").parquet(f"{path}/steps")
    schema = T.StructType([*selected.schema.fields, T.StructField("step", T.LongType())])
    return count, selected.sparkSession.read.schema(schema).parquet(f"{path}/steps")


@contextlib.contextmanager
def signals(stop: list[int]) -> Iterator[None]:
    """Note signals to stop instead of obeying them at once."""
    here = threading.current_thread() is threading.main_thread()  # only there can signals be taken
    numbers = [getattr(signal, n) for n in ("SIGTERM", "SIGINT", "SIGUSR1") if here and hasattr(signal, n)]
    before = {n: signal.signal(n, lambda got, _: stop.append(got)) for n in numbers}
    try:
        yield
    finally:
        for n, handler in before.items():
            signal.signal(n, handler)


def run(spark: SparkSession, config: Config, manifest_path: str, folder: str, resume: bool = False, max_seconds: float = MAX_SECONDS, max_new: int = 0, step: int = 100_000, infer: Callable[[DataFrame, Config], DataFrame] = results) -> int:
    """Run or resume; returns 0 if all rows are committed, else 75.

    What is pending is found and numbered once; rows are committed in steps of ``step``. A signal or the time limit
    ends the session after the step under way. The export is written in any case. What is written or shuffled on the
    way is deleted when it has been used.
    """
    if max_seconds <= 0 or max_new < 0:
        raise ValueError("max_seconds must be positive, max_new 0 or more")
    table = manifests.read(spark, manifest_path)
    selected = subset(table, config.limit, config.seed)
    schema = infer(selected.limit(0), config).schema
    stop: list[int] = []
    began, committed, session = time.monotonic(), 0, uuid.uuid4().hex
    todo_path = scratch.fresh(spark, "pending")
    with signals(stop), journal.lock(folder), scratch.freeing(spark), scratch.removed(spark, todo_path):
        book = journal.Journal(spark, folder, schema)
        terms = contract(config, table, selected)
        book.open(terms, resume)
        try:
            waiting, todo = steps(selected, book.done(), step, max_new, todo_path)
            if waiting:
                book.event("session_start", pending=waiting, resume=resume)
            some = min(waiting, max_new) if max_new else waiting
            for k in range(-(-some // step)):
                if stop or time.monotonic() - began >= max_seconds:
                    break
                rows = todo.where(F.col("step") == k).drop("step")
                book.put(infer(rows, config), f"{session}-{k:08d}", new=True)  # pending, and this is the only writer
                committed += min(step, some - k * step)
            book.event("session_end", new_results=committed, signals=stop, wall_seconds=time.monotonic() - began)
        except Exception as error:
            book.event("error", type=type(error).__name__, message=str(error)[:2000])
            raise
        finally:
            summary = journal.export(folder, terms, book.results())
    return COMPLETE if summary["complete"] else PARTIAL


def stream(source: DataFrame, config: Config, book: journal.Journal, checkpoint: str, infer: Callable[[DataFrame, Config], DataFrame] = results, stop: list[int] | None = None, name: str | None = None) -> StreamingQuery:
    """A streaming session over manifest rows: takes what is there, commits each micro-batch once, and ends.

    A batch is committed under the checkpoint's and its own number, so a repeated one is left out; rows whose ids are
    in the journal already are left out too. With ``stop``, a batch that begins after something was put into the list
    is refused untouched, and comes again when the stream is resumed.
    """
    key = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def commit(rows: DataFrame, number: int) -> None:
        if stop:
            raise Stopped(f"signal {stop[0]}")
        book.put(infer(rows, config), f"stream-{key}-{number:012d}")

    query = source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (query.queryName(name) if name else query).start()


class Stopped(Exception):
    """Ends a stream between two batches."""


class Events(StreamingQueryListener):
    """Writes the events of one named stream to its journal."""

    def __init__(self, book: journal.Journal, name: str):
        self.book, self.name, self.run, self.rows, self.batches = book, name, None, 0, 0
        self.ended = threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run = event.runId
            self.book.event("session_start", stream=self.name)

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.batches, self.rows = self.batches + 1, self.rows + p.numInputRows
            self.book.event("batch", batch=p.batchId, rows=p.numInputRows, milliseconds=dict(p.durationMs).get("triggerExecution"))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run is not None and event.runId == self.run:
            error = event.exception or ""
            if error and "Stopped: signal" not in error:
                self.book.event("error", type=event.errorClassOnException or "stream", message=error[:2000])
            else:
                self.book.event("session_end", batches=self.batches, rows=self.rows, stopped=bool(error))
            self.ended.set()


def run_stream(source: DataFrame, config: Config, book: journal.Journal, checkpoint: str, infer: Callable[[DataFrame, Config], DataFrame] = results, max_seconds: float = MAX_SECONDS, stop: list[int] | None = None) -> int:
    """A streaming session with its events in the journal; a signal or the time limit ends it between two batches.

    Returns 0 if all that was there is committed, else 75.
    """
    spark, stop, name = source.sparkSession, [] if stop is None else stop, f"session-{uuid.uuid4().hex}"
    events, began = Events(book, name), time.monotonic()
    spark.streams.addListener(events)
    try:
        with signals(stop):
            query = stream(source, config, book, checkpoint, infer, stop, name)
            try:
                while not query.awaitTermination(0.2):
                    if time.monotonic() - began >= max_seconds and not stop:
                        stop.append(0)
            except StreamingQueryException as error:
                if "Stopped: signal" not in str(error):
                    raise
                return PARTIAL
            return COMPLETE
    finally:
        events.ended.wait(30)  # the listener's events come by another thread
        spark.streams.removeListener(events)
