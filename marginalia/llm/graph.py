"""Connected components of an edge table, by steps that never gather an unbounded component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import lean, written

#: Forest edges (16 bytes each) that one task finishes; with more, rounds go on over the cluster.
ONE_TASK = 1_000_000
#: Edges that a task holds before it reduces them to a forest.
HELD = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of each component of the edges, with that least node.

    Each round hangs the larger root of an edge under the smaller and lets all nodes jump to their roots:
    at least half of the roots that still have an edge go.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


class Edges:
    """Edges that are reduced to forests now and then, so that a task holds few; ``add`` and ``rest`` give what leaves it."""

    def __init__(self, held: int = HELD):
        self.held, self.n = held, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((a, b))
        self.n += len(a)
        if self.n > self.held:
            (reduced,) = list(self.rest())
            if 2 * len(reduced[0]) > self.held:
                yield reduced
            else:
                self.parts, self.n = [reduced], len(reduced[0])

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n:
            parts, self.parts, self.n = self.parts, [], 0
            yield forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _forests(batches):
    edges = Edges()
    names = lambda found: (pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(p, pa.int64())], ["u", "p"]) for u, p in found)
    for batch in batches:
        yield from names(edges.add(batch.column("u").to_numpy(), batch.column("p").to_numpy()))
    yield from names(edges.rest())


def _whole(batches):
    """The forest of all edges of a task."""
    parts = [(batch.column("u").to_numpy(), batch.column("p").to_numpy()) for batch in batches]
    if parts:
        u, p = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(p, pa.int64())], ["u", "p"])


def components(edges: DataFrame, one_task: int = ONE_TASK, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges(a, b)``.

    Every partition first keeps a forest of its own edges, and fewer tasks join those forests as long as that
    leaves a quarter fewer edges. If few enough are left, one task joins the rest. Otherwise every round hangs each node under its smallest neighbour and jumps to that one's own
    parent; an edge to another neighbour becomes an edge between the two. Each round is written to the
    shared folder. Minima are taken before the shuffle; a hub's rows are left to the adaptive skew join.
    """
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p"))
    now = written(apart.mapInArrow(lean(_forests), "u long, p long"), "forests")
    before, n = None, now.count()
    while n > one_task > 0 and (before is None or 4 * n <= 3 * before):  # forests of several tasks have many edges in common
        now = written(now.repartition(-(-n // (2 * one_task)), "u", "p").mapInArrow(lean(_whole), "u long, p long"), "forests")
        before, n = n, now.count()
    if n <= one_task:
        return _stars(written(now.repartition(1).mapInArrow(lean(_whole), "u long, p long"), "forest"))
    now = now.distinct()
    for _ in range(rounds):
        parent = now.groupBy("u").agg(F.min("p").alias("m"))
        extra = now.join(parent, "u").where("p <> m").select(F.greatest("p", "m").alias("u"), F.least("p", "m").alias("p"), F.lit(True).alias("changed"))
        above = parent.select(F.col("u").alias("m"), F.col("m").alias("top"))
        jump = parent.join(above, "m", "left").select("u", F.coalesce("top", "m").alias("p"), F.col("top").isNotNull().alias("changed"))
        step = written(jump.unionByName(extra).groupBy("u", "p").agg(F.max("changed").alias("changed")), "edges")
        now = step.select("u", "p")
        if step.where("changed").isEmpty():
            return _stars(now)
    raise RuntimeError(f"no end after {rounds} rounds")


def _stars(edges: DataFrame) -> DataFrame:
    below = edges.select(F.col("u").alias("node"), F.col("p").alias("component"))
    return below.unionByName(edges.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())
