"""Scores of many rows with many rows, within groups: a matrix product in blocks.

Each group's two sides are cut into blocks of bounded rows by their counts, and each pair of blocks is a group of
one shuffle, so a hot group becomes many tasks and no side of one is ever whole in a task. Vectors of a pair are
multiplied as matrices.

Defined cases: a null or empty vector, one with a null or non-finite component or of length zero has no cosine
and takes no part, nor does a row with a null group or key; vectors of unlike length raise; ties go to the
smaller key; left keys are unique, repeated right rows are rows each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.blocks import meet

#: Rows of a block on the held and on the streamed side, and held rows that are multiplied at once.
HELD, STREAMED, AT_ONCE = 4096, 1 << 16, 256
_CELL = ["group", "_a", "_b"]


def _fit(rows: DataFrame, group: str, key: str, vector: str, name: str = "key") -> DataFrame:
    v = F.col(vector)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine & F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("group"), F.col(key).alias(name), v.cast("array<double>").alias("v"))


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of length one."""
    size = np.unique(np.diff(column.offsets.to_numpy()))
    if len(size) > 1:
        raise ValueError("vectors of one group differ in length")
    offsets = column.offsets.to_numpy()
    v = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _cells(left: DataFrame, right: DataFrame, held: int, streamed: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their blocks: each row once for each block of the other side."""
    count = lambda rows, name: rows.groupBy("group").agg(F.ceil(F.count("*") / F.lit({"_n": held, "_m": streamed}[name])).cast("int").alias(name))
    sizes = count(left, "_n").join(count(right, "_m"), "group")  # a row a group
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(key, "v"), F.col(n)).cast("int")
    a = left.join(sizes, "group").select("group", "key", "v", block("key", "_n").alias("_a"), spread("_m").alias("_b"))
    b = right.join(sizes, "group").select("group", "other", "v", spread("_n").alias("_a"), block("other", "_m").alias("_b"))
    return a, b


def _products(table: pa.Table, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``(left keys, right keys in order, scores)`` of a block with each streamed batch."""
    keys = table["key"].combine_chunks()
    units = np.concatenate([_units(x) for x in table["v"].chunks])
    for batch in batches:
        other = _units(batch.column("v"))
        if other.shape[1] != units.shape[1]:
            raise ValueError("vectors of one group differ in length")
        ids = batch.column("other").to_numpy()
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(keys), AT_ONCE):
            yield keys.slice(at, AT_ONCE), ids[order], units[at : at + AT_ONCE] @ other[order].T


def top(left: DataFrame, right: DataFrame, k: int, digits: int | None = None, group: str = "group", key: str = "key", other: str = "key", vector: str = "vector", held: int = HELD, streamed: int = STREAMED) -> DataFrame:
    """``group, key, rank, other, score``: for each left row the k right rows of its group of highest cosine.

    ``other`` is the right side's key, a whole number. With ``digits``, scores are rounded first, so that order does not hang on the last bits of a sum.
    """

    def run(table, batches):
        best: list[tuple] = []
        for keys, others, scores in _products(table, batches):
            scores = scores if digits is None else np.round(scores, digits)
            floor = np.partition(scores, scores.shape[1] - k, 1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            i, j = np.nonzero(scores >= floor[:, None])
            order = np.lexsort((others[j], -scores[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)  # of equals the smaller key
            some = np.arange(len(i)) - first < k
            best.append((keys.take(pa.array(i[some])), others[j[some]], scores[i[some], j[some]]))
        group_of = table["group"].chunk(0)
        for keys, others, scores in best:
            yield pa.RecordBatch.from_arrays([pa.repeat(group_of[0], len(keys)), keys, pa.array(others, pa.int64()), pa.array(scores)], ["group", "key", "other", "score"])

    a, b = _cells(_fit(left, group, key, vector), _fit(right, group, other, vector, "other").withColumn("other", F.col("other").cast("long")), held, streamed)
    group_kind, key_kind = (a.schema[c].dataType.simpleString() for c in ("group", "key"))
    found = meet(a, b, _CELL, run, f"group {group_kind}, key {key_kind}, other long, score double")
    order = Window.partitionBy("group", "key").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("group", "key", "rank", "other", "score")


def rows(left: DataFrame, right: DataFrame, group: str = "group", key: str = "key", other: str = "key", vector: str = "vector", held: int = HELD, streamed: int = STREAMED) -> DataFrame:
    """``group, key, scores``: for each left row its cosines with all right rows of its group, in order of their keys.

    Keys are unique on either side. A row of the result is as long as its group's right side.
    """

    def run(table, batches):
        group_of = table["group"].chunk(0)
        for keys, others, scores in _products(table, batches):
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(others))
            pair = pa.StructArray.from_arrays([pa.array(np.tile(others, len(keys)), pa.int64()), pa.array(scores.reshape(-1))], ["other", "score"])
            yield pa.RecordBatch.from_arrays([pa.repeat(group_of[0], len(keys)), keys, pa.ListArray.from_arrays(ends, pair)], ["group", "key", "part"])

    a, b = _cells(_fit(left, group, key, vector), _fit(right, group, other, vector, "other").withColumn("other", F.col("other").cast("long")), held, streamed)
    group_kind, key_kind = (a.schema[c].dataType.simpleString() for c in ("group", "key"))
    found = meet(a, b, _CELL, run, f"group {group_kind}, key {key_kind}, part array<struct<other:bigint,score:double>>")
    whole: Column = F.array_sort(F.flatten(F.collect_list("part")))
    return found.groupBy("group", "key").agg(whole.alias("p")).select("group", "key", F.col("p.score").alias("scores"))
