"""Exact top-k search: exhaustive term-at-a-time accumulation of integer inner products.

Vectors become sparse rows of integer weights. Candidates are held in blocks as postings by term; for
each block of queries the postings of every term are scattered, times the query's weight, into a dense
array of scores; the best k of each row are selected by partition and merged. Queries of at most
``QUERY_BYTES`` as a dense matrix are broadcast, one pass over the candidates. More of them stay on the
executors: queries and candidates are dealt into blocks, every pair of blocks is one group of a shuffle, and
in each group the queries come first and the candidates stream past them. Any number of queries is exact.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a
row with a null id; vectors of unlike length are scored over the terms both have; a score that does not fit
64 bits is refused with an error (where weights are so large that one might, scores are whole numbers of any
size); ties go to the smaller id; repeated rows are candidates each, and
a query's own id is never one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, lean, written

SCALE = 64
#: Bytes of a block of queries as a dense matrix, and candidates of a block where both are dealt.
QUERY_BYTES, CANDIDATES = 32 << 20, 1 << 18
ROWS, COLUMNS = 128, 4096
TOO_LARGE = "does not fit 64 bits"


def weights(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as double, as integers; null if the vector takes no part."""
    fit = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Ragged rows as a dense matrix of ``width`` terms, of the rows' kind."""
    out = np.zeros((len(column), width), np.float64 if pa.types.is_floating(column.type.value_type) else np.int64)
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
    fits = at < width
    out[row[fits], at[fits]] = flat[ends[0] : ends[-1]][fits]
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, one term after the other, from sparse postings."""
    if queries.dtype == np.float64:
        return exact(queries, candidates)
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float32 if bound < 1 << 24 else np.int64  # both exact
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        holds = np.flatnonzero(candidates[:, term])
        asks = np.flatnonzero(queries[:, term])
        if not len(holds) or not len(asks):
            continue
        weight = queries[asks, term].astype(kind)[:, None]
        if 2 * len(holds) > len(candidates):  # postings of most rows: without gaps
            part = weight * candidates[:, term].astype(kind)
            if len(asks) == len(queries):
                scores += part
            else:
                scores[asks] += part
        else:
            scores[np.ix_(asks, holds)] += weight * candidates[holds, term].astype(kind)
    return scores


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, in whole numbers of any size."""
    whole = np.vectorize(int, otypes=[object])
    scores = whole(queries) @ whole(candidates).T
    if scores.size and max(scores.max(), -scores.min()) > np.iinfo(np.int64).max:
        raise ValueError(f"a score {TOO_LARGE}")
    return scores.astype(np.int64)


class _Best:
    """The best k of each query so far; of equal scores the smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min + 1)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, score, i = (np.concatenate(x) for x in ((self.row, rows), (self.score, scores), (self.id, ids)))
        order = np.lexsort((i, -score, row))
        row, score, i = row[order], score[order], i[order]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], i[keep]
        full = rank == self.k - 1
        self.least[row[full]] = score[full]


def _select(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k best, of equals the first, that are not under what the row has already."""
    floor = least.astype(scores.dtype)
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    chosen = scores >= floor[:, None]
    for i in np.flatnonzero(chosen.sum(1) > k):
        at = np.flatnonzero(chosen[i])
        chosen[i, at[np.argsort(-scores[i, at], kind="stable")[k:]]] = False
    return np.nonzero(chosen)


def _searched(ids: np.ndarray, q: np.ndarray, batches, k: int):
    """The best k candidates of each query, of batches ``id, w``."""
    best = _Best(len(ids), k)
    for batch in batches:
        names, held = batch.column("id").to_numpy(), _matrix(batch.column("w"), q.shape[1])
        order = np.argsort(names, kind="stable")
        names, held = names[order], held[order]
        for c in range(0, len(names), COLUMNS):
            some, block = names[c : c + COLUMNS], held[c : c + COLUMNS]
            picked = []
            for a in range(0, len(ids), ROWS):
                s = accumulate(q[a : a + ROWS], block)
                s[ids[a : a + ROWS, None] == some] = -np.inf if s.dtype == np.float32 else np.iinfo(np.int64).min
                i, j = _select(s, k, best.least[a : a + ROWS])
                picked.append((i + a, some[j], s[i, j].astype(np.int64)))
            best.add(*(np.concatenate(x) for x in zip(*picked, strict=True)))
    if len(best.row):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[best.row], best.id, best.score)], ["query_id", "vec_id", "score"])


def _dealt(rows: DataFrame, query_blocks: int, candidate_blocks: int, width: int, k: int) -> DataFrame:
    """Each block of queries against each block of candidates, on the executors."""
    queries = rows.where("q").select("id", "w", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("a"), _each(candidate_blocks).alias("b"), F.lit(0).alias("side"))
    candidates = rows.select("id", "w", _each(query_blocks).alias("a"), F.pmod(F.xxhash64("id", "w"), F.lit(candidate_blocks)).alias("b"), F.lit(1).alias("side"))

    def run(batches):
        parts = (batch.slice(a, b - a) for batch in batches for a, b in _cells(batch))
        for _, cell in itertools.groupby(parts, lambda x: _cell(x)[:2]):
            ids, matrix = [], []
            for part in cell:
                if _cell(part)[2]:
                    if ids:
                        yield from _searched(np.concatenate(ids), np.concatenate(matrix), itertools.chain([part], cell), k)
                    break
                ids.append(part.column("id").to_numpy())
                matrix.append(_matrix(part.column("w"), width))

    every = queries.unionByName(candidates)
    tasks = min(query_blocks * candidate_blocks, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return every.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(lean(run), "query_id long, vec_id long, score long")


def _each(n: int) -> Column:
    """A row for each number under n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _cell(batch: pa.RecordBatch) -> tuple[int, int, int]:
    return tuple(batch.column(c)[0].as_py() for c in ("a", "b", "side"))


def _cells(batch: pa.RecordBatch):
    """Runs of rows of one pair of blocks and one side."""
    if batch.num_rows:
        key = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "side")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        yield from zip(edges, edges[1:], strict=False)


def _best(rows: DataFrame, known, block: int, candidate_block: int, width: int, k: int) -> DataFrame:
    """The result for ``rows(id, w, q)``."""
    spark = rows.sparkSession
    if known["queries"] > block:
        every = _dealt(rows, -(-known["queries"] // block), max(1, -(-known["rows"] // candidate_block)), width, k)
    elif known["queries"]:
        asked = rows.where("q").select("id", "w").toArrow()  # at most a block
        shared = spark.sparkContext.broadcast((asked["id"].to_numpy(), np.concatenate([_matrix(x, width) for x in asked["w"].chunks])))
        every = rows.select("id", "w").mapInArrow(lean(lambda batches: _searched(*shared.value, batches, k)), "query_id long, vec_id long, score long")
    else:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _large(rows: DataFrame, known, block: int, candidate_block: int, width: int, k: int) -> DataFrame:
    """The same with weights as doubles, which hold any of them, and whole numbers of any size; done at once, so that it raises here."""
    try:
        return written(_best(rows, known, block, candidate_block, width, k), "large-scores")
    except Exception as error:
        if TOO_LARGE in str(error):
            raise ValueError(f"a score {TOO_LARGE}") from error
        raise


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int | None = None, candidate_block: int = CANDIDATES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row where ``is_query``.

    ``query_block`` is the number of queries of a block, by default as many as ``QUERY_BYTES`` hold.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    largest = F.array_max(F.transform(F.col(vector_col), lambda x: F.abs(F.lit(scale) * x.cast("double")) + 1))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col), scale).alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"), largest.alias("largest")).where("w is not null and id is not null")
    known = rows.agg(F.count_if("q").alias("queries"), F.count("*").alias("rows"), F.max(F.size("w")).alias("width"), F.max("largest").alias("largest")).first()
    width = max(1, known["width"] or 0)
    block = query_block or max(1, QUERY_BYTES // (8 * width))
    if (known["largest"] or 0.0) ** 2 * width >= 2.0**62:
        product = lambda x: F.lit(scale) * x.cast("double")
        double = F.transform(F.col(vector_col), lambda x: F.when(F.abs(product(x)) < 2.0**53, F.floor(product(x)).cast("double")).otherwise(product(x)))
        doubles = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(weights(F.col(vector_col), scale).isNotNull(), double).alias("w"), F.coalesce(is_query, F.lit(False)).alias("q")).where("w is not null and id is not null")
        each = doubles.select("q", F.posexplode("w").alias("term", "x")).groupBy("term").agg(F.max(F.when(F.col("q"), F.abs("x"))).alias("q"), F.max(F.abs("x")).alias("c"))
        if each.agg(F.sum(F.coalesce("q", F.lit(0.0)) * F.col("c")).alias("s")).first()["s"] >= 2.0**62 or known["largest"] >= 2.0**62:
            return _large(doubles, known, block, candidate_block, width, k)
    rows = rows.drop("largest")
    return _best(rows, known, block, candidate_block, width, k)
