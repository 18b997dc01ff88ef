"""Two tables met group by group on the executors: one side's rows of a group are held, the other's stream past."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = Callable[[pa.Table, Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of equal keys, with the keys' values."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows - 1, bool)
    for c in keys:
        column = batch.column(c)
        a, b = column.slice(1), column.slice(0, batch.num_rows - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new |= ~same.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for x, y in zip(edges, edges[1:], strict=False):
        yield tuple(batch.column(c)[x].as_py() for c in keys), batch.slice(x, y - x)


def meet(held: DataFrame, streamed: DataFrame, keys: list[str], run: Run, schema: str, tasks: int | None = None, wrap: Callable = lambda f: f) -> DataFrame:
    """``run(held rows, streamed batches)`` for each value of ``keys`` that both sides have.

    Both sides have the key columns. The keys must bound how many held rows share them; streamed ones may be any number.
    ``wrap`` goes around the Arrow function of each task.
    """
    side = "_side"
    every = held.withColumn(side, F.lit(0)).unionByName(streamed.withColumn(side, F.lit(1)), allowMissingColumns=True)

    def met(batches):
        parts = (part for batch in batches for part in runs(batch, [*keys, side]))
        for _, group in itertools.groupby(parts, lambda p: p[0][:-1]):
            some = []
            for key, part in group:
                if key[-1]:
                    if some:
                        yield from run(pa.Table.from_batches(some), itertools.chain([part], (p for _, p in group)))
                    break
                some.append(part)

    tasks = tasks or int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(tasks, *keys).sortWithinPartitions(*keys, side).mapInArrow(wrap(met), schema)
