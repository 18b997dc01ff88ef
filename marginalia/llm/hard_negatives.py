"""Hard-negative mining: dual-tree search with inner-product intervals.

Anchors and blocks of candidates each become a tree of balls, cut by label first and by space below. For a
pair of nodes, centres and radii bound all inner products between them; a pair is left out for the whole
group of anchors if that interval misses what each of them still looks for, or if the labels forbid it. Pairs
of leaves are scored exactly. It runs twice: for the best rows of an anchor's own label, its positives, and
for the best rows of other labels whose scores lie in a band below each positive's.

Anchors of at most ``ANCHOR_BYTES`` are broadcast, one pass over the candidates. More of them stay on the
executors: anchors and candidates are dealt into blocks and every pair of blocks is one group of a shuffle.

Defined cases: a row with a null id, label or vector, or a null or non-finite component, takes no part;
vectors of unlike length are scored over the terms both have; ties go to the smaller id; repeated rows are
candidates each, rows with an anchor's id are never its own partners, and of anchors that share an id the one
with the smallest label and vector counts; an anchor without positives, or with nothing in a band, gives no
rows; a score beyond 64 bits raises; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, lean, meet, written
from marginalia.llm.topk_search import _Best, _select, exact

SCALE, POSITIVES, NEGATIVES, BAND = 256, 5, 3, (50, 95)
#: Bytes of a block of anchors and of candidates as dense matrices; rows of a leaf.
ANCHOR_BYTES, CANDIDATE_BYTES, DEALT_BYTES, LEAF = 32 << 20, 16 << 20, 128 << 20, 128
LOWEST, HIGHEST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


class Tree:
    """Rows in balls: each node is a run of the rows, with centre, radius, greatest norm and range of labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, w: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        self.start, self.end, self.children, self.parent = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.start)
            self.start.append(a)
            self.end.append(b)
            self.children.append([])
            self.parent.append(parent)
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= leaf:
                order[a:b] = np.sort(order[a:b])[np.argsort(ids[np.sort(order[a:b])], kind="stable")]
                continue
            some = order[a:b]
            k = labels[some]
            if k.min() < k.max():  # in order of label still
                cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
                at = a + int(cuts[np.argmin(np.abs(cuts - (b - a) // 2))])
            else:
                at = a + (b - a) // 2
                far = w[some[_farthest(w[some], w[some].mean(0))]]
                along = w[some] @ (w[some[_farthest(w[some], far)]] - far)
                order[a:b] = some[np.argpartition(along, at - a)]
            todo += [(a, at, node), (at, b, node)]
        self.ids, self.labels, self.w = ids[order], labels[order], w[order]
        runs = [slice(a, b) for a, b in zip(self.start, self.end, strict=True)]
        self.centre = np.stack([self.w[r].mean(0) for r in runs])
        self.size = np.sqrt((self.centre**2).sum(1))
        self.radius = np.array([np.sqrt(((self.w[r] - c) ** 2).sum(1).max()) for r, c in zip(runs, self.centre, strict=True)])
        norms = np.sqrt((self.w**2).sum(1))
        self.norm = np.array([norms[r].max() for r in runs])
        self.least, self.most = (np.array([f(self.labels[r]) for r in runs]) for f in (np.min, np.max))

    def interval(self, a: int, other: Tree, c: int) -> tuple[float, float]:
        """Bounds of all inner products between two nodes, wide enough for rounding."""
        middle = float(self.centre[a] @ other.centre[c])
        reach = self.radius[a] * other.size[c] + other.radius[c] * self.size[a] + self.radius[a] * other.radius[c]
        reach += 1 + 1e-9 * (self.size[a] * other.size[c] + reach)
        top = self.norm[a] * other.norm[c] * (1 + 1e-9) + 1
        return max(middle - reach, -top), min(middle + reach, top)


def _farthest(w: np.ndarray, point: np.ndarray) -> int:
    return int(((w - point) ** 2).sum(1).argmax())


def products(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; ``limit`` bounds the product of any two norms."""
    return a @ b.T if limit < 2.0**52 else exact(a, b)


class Search:
    """What each anchor looks for, in one or more bands of scores, and the best it has."""

    def __init__(self, anchors: Tree, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        """``low`` and ``high``: rows are anchors, in the tree's order, columns their bands."""
        self.tree, self.low, self.high, self.same = anchors, low, high, same
        self.bands = low.shape[1]
        self.best = {n: _Best((anchors.end[n] - anchors.start[n]) * self.bands, k) for n in range(len(anchors.start)) if not anchors.children[n]}
        runs = [slice(a, b) for a, b in zip(anchors.start, anchors.end, strict=True)]
        self.need = np.array([low[r].min(initial=HIGHEST) for r in runs], float)  # a group's least wanted score
        self.cap = np.array([high[r].max(initial=LOWEST) for r in runs], float)

    def look(self, rows: Tree) -> None:
        """Meet a tree of candidates, the most promising pairs of nodes first."""
        todo = [(0, 0)]
        while todo:
            a, c = todo.pop()
            if self._hopeless(a, rows, c):
                continue
            left, right = self.tree.children[a], rows.children[c]
            if not left and not right:
                self._score(a, rows, c)
                continue
            pairs = [(x, y) for x in left or [a] for y in right or [c]]
            todo += sorted(pairs, key=lambda p: self.tree.interval(p[0], rows, p[1])[1])

    def _hopeless(self, a: int, rows: Tree, c: int) -> bool:
        mine = self.tree
        if self.same:
            if mine.least[a] > rows.most[c] or rows.least[c] > mine.most[a]:
                return True
        elif mine.least[a] == mine.most[a] == rows.least[c] == rows.most[c]:
            return True
        low, high = mine.interval(a, rows, c)
        return high < self.need[a] or low > self.cap[a]

    def _score(self, a: int, rows: Tree, c: int) -> None:
        mine, best = self.tree, self.best[a]
        i, j = slice(mine.start[a], mine.end[a]), slice(rows.start[c], rows.end[c])
        scores = products(mine.w[i], rows.w[j], mine.norm[a] * rows.norm[c])
        out = -np.inf if scores.dtype == np.float64 else LOWEST - 1
        fit = (mine.ids[i, None] != rows.ids[None, j]) & ((mine.labels[i, None] == rows.labels[None, j]) == self.same)
        low, high = self.low[i].reshape(-1, 1), self.high[i].reshape(-1, 1)
        every = np.repeat(scores, self.bands, 0)
        every = np.where(np.repeat(fit, self.bands, 0) & (every >= low) & (every <= high), every, out)
        r, p = _select(every, best.k, best.least)
        if len(r):
            best.add(r, rows.ids[j][p], every[r, p].astype(np.int64))
            wanted = np.maximum(best.least, self.low[i].reshape(-1))[self.high[i].reshape(-1) >= self.low[i].reshape(-1)]
            self.need[a] = wanted.min(initial=HIGHEST)
            while (a := mine.parent[a]) >= 0:
                self.need[a] = self.need[mine.children[a]].min()

    def found(self):
        """Places of anchors, bands, ids and scores."""
        for node, best in self.best.items():
            yield self.tree.start[node] + best.row // self.bands, best.row % self.bands, best.id, best.score


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Ragged rows of scaled components as whole numbers in ``width`` columns of doubles."""
    out = np.zeros((len(column), width))
    ends = column.offsets.to_numpy()
    size = np.diff(ends)
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
    fits = at < width
    out[row[fits], at[fits]] = np.floor(column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]][fits])
    return out


def _trees(batches, width: int):
    """Trees of blocks of candidates."""
    held, size = [], 0

    def tree():
        return Tree(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "label")), np.concatenate([dense(b.column("w"), width) for b in held]))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows * width * 8
        if size >= CANDIDATE_BYTES:
            yield tree()
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield tree()


def _bands(scores: list[list[int]], band: tuple[int, int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores between the hundredths ``band`` of each positive's, an empty band where there is none."""
    low, high = np.full((len(scores), width), HIGHEST), np.full((len(scores), width), LOWEST)
    for i, row in enumerate(scores):
        for j, s in enumerate(row):
            a, b = -(-band[0] * s // 100), band[1] * s // 100
            if a <= b <= HIGHEST:
                low[i, j], high[i, j] = a, b
    return low, high


def _searcher(width: int, k: int, band: tuple[int, int] | None, n_bands: int):
    """A function of a block of anchors and batches of candidates; ``band`` None looks for positives."""

    def run(anchors: pa.Table, batches):
        if not anchors.num_rows:
            return
        ids, labels = (anchors[c].to_numpy() for c in ("id", "label"))
        w = np.concatenate([dense(x, width) for x in anchors["w"].chunks])
        tree = Tree(ids, labels, w, LEAF // 2)
        if band is None:
            low, high = np.full((len(ids), 1), LOWEST), np.full((len(ids), 1), HIGHEST)
        else:
            where = {v: i for i, v in enumerate(ids.tolist())}
            scores = anchors["scores"].to_pylist()
            low, high = _bands([scores[where[v]] for v in tree.ids.tolist()], band, n_bands)
        search = Search(tree, low, high, k, band is None)
        for rows in _trees(batches, width):
            search.look(rows)
        for at, slot, found, score in search.found():
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (tree.ids[at], slot, found, score)], ["anchor_id", "slot", "found_id", "score"])

    return run


def _first(anchors: DataFrame, rows: DataFrame, run, anchor_block: int, candidate_block: int, counts: tuple[int, int], k: int) -> DataFrame:
    """``anchor_id, slot, found_id, score, rank``: the first k of each anchor's band."""
    schema = "anchor_id long, slot long, found_id long, score long"
    if counts[0] <= anchor_block:
        shared = anchors.sparkSession.sparkContext.broadcast(anchors.toArrow())  # at most a block
        every = rows.mapInArrow(lean(lambda batches: run(shared.value, batches)), schema)
    else:
        every = meet(anchors, rows, "id", -(-counts[0] // anchor_block), max(1, -(-counts[1] // candidate_block)), run, schema)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, anchor_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` is the column that tells rows apart, by default ``label``. A negative's score lies between the
    hundredths ``band`` of the positive's. The blocks are numbers of rows, by default from their bytes.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v, label = F.col(vector_col), F.col("label") if label is None else label
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fit, F.transform(v, lambda x: x.cast("double") * F.lit(scale))).alias("w"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    rows = rows.where("id is not null and label is not null and w is not null")
    anchors = rows.where("q").groupBy("id").agg(F.min(F.struct("label", "w")).alias("x")).select("id", "x.label", "x.w")
    rows = rows.drop("q")
    anchors = written(anchors, "anchors")
    known = anchors.agg(F.count("*").alias("n"), F.max(F.size("w")).alias("width")).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known["n"]:
        return spark.createDataFrame([], empty)
    width = max(1, known["width"])
    anchor_block = anchor_block or max(1, ANCHOR_BYTES // (8 * width))
    candidate_block = candidate_block or max(1, DEALT_BYTES // (8 * width))
    n = rows.count() if known["n"] > anchor_block else 0
    found = _first(anchors, rows, _searcher(width, positives, None, 1), anchor_block, candidate_block, (known["n"], n), positives)
    listed = F.array_sort(F.collect_list(F.struct("rank", "found_id", "score")))
    pos = written(found.groupBy(F.col("anchor_id").alias("id")).agg(listed.alias("p")).select("id", F.col("p.found_id").alias("ids"), F.col("p.score").alias("scores")), "positives")
    asked = written(anchors.join(pos.select("id", "scores"), "id"), "asked")
    got = _first(asked, rows, _searcher(width, negatives, band, positives), anchor_block, candidate_block, (known["n"], n), negatives)
    return got.join(pos, F.col("anchor_id") == F.col("id")).select("anchor_id", F.get("ids", F.col("slot").cast("int")).alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.get("scores", F.col("slot").cast("int")).alias("positive_score"), F.col("score").alias("negative_score"))
