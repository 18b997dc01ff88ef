"""Shared helpers of the training-data operators: scratch tables, batch slicing, label folds."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import blocks
from marginalia.sources.scratch import written  # noqa: F401

#: Rows of one Arrow batch are handled in slices of about this many text bytes.
SLICE_BYTES = 4 << 20
#: What an Arrow batch may hold, unless the session says otherwise.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b", f"{8 << 20}b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Where the session has Spark's own bound of an Arrow batch's bytes (64 MB), set a smaller one: texts may be long."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives freed memory back after each batch: all workers of an executor share its limit."""

    def given(batches, trim):
        for batch in batches:
            yield batch
            del batch
            trim(0)

    def lean_run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)  # only glibc has it
        yield from run(given(batches, trim))
        trim(0)

    return lean_run


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts add up to about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; a null text counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def runs_of_words(folded: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text between single bytes of white space, about ``limit`` bytes of it at a time."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + limit) if len(folded) - at > limit else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def hashes_of(folded: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    digest = xxhash.xxh3_64_intdigest
    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(digest, ws), np.uint64, len(ws)) for ws in runs_of_words(folded))])


def groups(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of one value of ``column`` after the other, of batches in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                if held and held[-1].column(column)[0].as_py() != key[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def each(n: int) -> Column:
    """A row for each number under n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def meet(left: DataFrame, right: DataFrame, key: str, left_blocks: int, right_blocks: int, run: blocks.Run, schema: str) -> DataFrame:
    """``run(block of left, batches of right)`` for each pair of blocks, on the executors.

    The left rows, one of each ``key``, are dealt by its hash, the right ones by their own. A pair is one group of
    a shuffle, in which the left rows come first and are held, and the right ones stream past them.
    """
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n))
    a = left.select("*", block(left_blocks, key).alias("_a"), each(right_blocks).alias("_b"))
    b = right.select("*", each(left_blocks).alias("_a"), block(right_blocks, *right.columns).alias("_b"))
    tasks = min(left_blocks * right_blocks, 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.meet(a, b, ["_a", "_b"], run, schema, tasks, lean)


def held_out(doc_id: Column) -> Column:
    """True for the fold labels are never learned from: CRC-32 of the id's decimal text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def labelled(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """``id, y``: labelled ids that may be learned from, at most ``bound`` of each label, first by hash of the id.

    Rows with a null id or label, of the held-out fold, or of contrary labels for one id are left out.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    one = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    first = [one.where(F.col("y") == k).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(bound) for k in (0, 1)]
    return first[0].unionByName(first[1])


def label_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> tuple[int, int]:
    """How many rows that may be learned from have label 0 and 1."""
    fit = labels.where(~held_out(F.col(id_col)))
    row = fit.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    return row["a"], row["b"]
