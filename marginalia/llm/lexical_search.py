"""Ranked lexical search: sort-based accumulation of integer impacts.

Documents are read once and become postings: how often each asked term stands in a document. What the weights
need (documents, terms, documents of a term) is counted from the postings. Then tasks concatenate arrays of item,
document and impact of all matches, order their packed keys by radix, 16 bits at a time, add up runs of equal
keys, and keep the best of each item in a heap. What tasks keep is partitioned by ranges of items and ranked.
Items are asked in blocks of ``BLOCK_BYTES`` of text, of which one is on the driver at a time.

Defined cases: a null text has no terms, as an item and as a document; items of one id are one item with the
terms of all, and an item with a null id is not asked; a document with a null id counts in all statistics and
is not ranked; repeated rows are documents each; equal scores go to the smaller id; only scores above 0 are
ranked; an empty table gives no rows; long texts are split a megabyte at a time; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.llm.common import bound_batches, lean, runs_of_words, slices, texts_of, written

BEST, BLOCK_BYTES = 50, 4 << 20
#: Matches that are ordered at once.
MATCHES = 2 << 20
#: Bytes as terms see them: letters and digits and all beyond ASCII stay, A-Z become small, all else parts terms.
_FOLD = bytes(i if i >= 128 or chr(i).isalnum() and not chr(i).isupper() else i + 32 if chr(i).isupper() else 32 for i in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in parts."""
    return runs_of_words(text.encode().translate(_FOLD))


class Items:
    """A block of items: their terms, and the items of each term."""

    def __init__(self, texts: list[tuple[object, str]]):
        of: dict[object, set[bytes]] = {}
        for name, text in texts:
            of.setdefault(name, set()).update(itertools.chain.from_iterable(terms(text)))
        self.names = list(of)
        self.terms = sorted(set().union(*of.values())) if of else []
        code = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((code[t], i) for i, name in enumerate(self.names) for t in of[name])
        self.items = np.array([i for _, i in pairs], np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))


def counted(batch: pa.RecordBatch, code: dict[bytes, int]) -> pa.RecordBatch:
    """``id, n, terms, tfs`` of a slice of texts: all terms of each, the asked ones and how often they stand there."""
    found, n = [], np.zeros(batch.num_rows, np.int64)
    for i, text in enumerate(texts_of(batch)):
        for run in terms(text):
            n[i] += len(run)
            codes = np.fromiter(map(code.get, run, itertools.repeat(-1)), np.int64, len(run))
            found.append(codes[codes >= 0] + i * len(code))
    key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(code)).astype(np.int32)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), listed(key % max(1, len(code))), listed(tf)], ["id", "n", "terms", "tfs"])


def radix(keys: np.ndarray) -> np.ndarray:
    """The order of whole numbers from 0 up, by 16 bits at a time from the lowest (numpy's stable order of 16 bits is a radix sort)."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    return order


class Ranks:
    """The best documents of each item so far, in heaps."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[item]
        if len(heap) == self.k:
            some = scores >= heap[0][0]
            ids, scores = ids[some], scores[some]
        if len(ids) > self.k:
            some = scores >= np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[some], scores[some]
            some = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[some], scores[some]
        for x in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, x)
            else:
                heapq.heappushpop(heap, x)


def impacts(n: np.ndarray, rows: np.ndarray, of: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting (row of ``n``, term, occurrences) adds to a score."""
    sizes, which = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * x * documents // length for x in sizes.tolist()], np.int64)[which]  # any size of product
    return weight[of] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))


def accumulate(batch: pa.RecordBatch, items: Items, weight: np.ndarray, documents: int, length: int, ranks: Ranks) -> None:
    """Add a batch of postings to the ranks."""
    ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
    ends = batch.column("terms").offsets.to_numpy()
    of, tf = (batch.column(c).values.to_numpy()[ends[0] : ends[-1]].astype(np.int64) for c in ("terms", "tfs"))
    rows = np.repeat(np.arange(len(ids)), np.diff(ends))
    impact = impacts(n, rows, of, tf, weight, documents, length)
    matches = items.starts[of + 1] - items.starts[of]
    upto = np.append(0, np.cumsum(matches))[ends - ends[0]]  # matches before each document
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + MATCHES, "right")) - 1)
        some = slice(ends[a] - ends[0], ends[b] - ends[0])
        count = matches[some]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = items.items[np.repeat(items.starts[of[some]], count) + within]
        key = item * (b - a) + np.repeat(rows[some] - a, count)
        order = radix(key)
        key, value = key[order], np.repeat(impact[some], count)[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if len(starts):
            score, key = np.add.reduceat(value, starts), key[starts]
            key, score = key[score > 0], score[score > 0]
            item, at = key // (b - a), key % (b - a) + a
            edges = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item)) if len(item) else [0]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                ranks.add(int(item[x]), ids[at[x:y]], score[x:y])
        a = b


def _blocks(benchmark: DataFrame, item_col: str, block_bytes: int) -> Iterator[Items]:
    """The items in blocks, one on the driver at a time."""
    asked = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        items = Items([(r["item"], r["text"]) for r in part.collect()])
        if items.terms:
            yield items


def _ranked(docs: DataFrame, items: Items, kind, k: int) -> DataFrame:
    """``item, doc_id, score`` that tasks keep of one block of items."""
    spark = docs.sparkSession
    code = spark.sparkContext.broadcast({t: i for i, t in enumerate(items.terms)})
    postings = written(docs.mapInArrow(lean(lambda batches: (counted(part, code.value) for batch in batches for part in slices(batch))), "id long, n long, terms array<int>, tfs array<int>"), "postings")
    known = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    held = np.zeros(len(items.terms))
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a row for each asked term
        held[r["term"]] = r["n"]
    documents, length = known["documents"], known["length"] or 0
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
    shared, item_type = spark.sparkContext.broadcast((items, weight)), to_arrow_type(kind)

    def run(batches):
        items, weight = shared.value
        ranks = Ranks(len(items.names), k)
        for batch in batches:
            accumulate(batch, items, weight, documents, length, ranks)
        rows = [(item, -doc, score) for item, heap in enumerate(ranks.heaps) for score, doc in heap]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([items.names[i] for i in item], item_type), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    out = written(postings.where("id is not null and size(terms) > 0").mapInArrow(lean(run), f"item {kind.simpleString()}, doc_id long, score long"), "ranked")
    code.destroy()
    shared.destroy()
    return out


def search(docs: DataFrame, benchmark: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col, rank, id_col, score``: the k best documents of each item."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = benchmark.schema[item_col].dataType
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = None
    for items in _blocks(benchmark, item_col, block_bytes):
        part = _ranked(source, items, kind, k)
        every = part if every is None else every.unionByName(part)
    if every is None:
        return spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, {id_col} long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = every.repartitionByRange("item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
