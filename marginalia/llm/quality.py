"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators of a whole text: byte trigrams; n-grams of the stream of character classes, and of the stream
that tells how far back a word or line was last seen, each at four levels of density. Indicators are
scaled by the log ratio of their smoothed class counts, rows to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent on a bounded sample of labelled rows (``bound`` of each label). Part
of the sample is kept out to turn margins into probabilities, weighted back to the labels' real shares.

Texts are turned into indicators on the executors, for the sample and for all rows alike; the driver gets
the sample's indicators only. Defined cases: a null or empty text has the score of a text without
indicators; a null id is not held out; repeated rows are scored each; without rows of both labels every
score is the share of label 1 (0.5 without any); a very long text is taken in blocks of ``BLOCK`` bytes, so it
costs its own bytes twice and no more; an empty table gives an empty result; labels, language, source and id
are never inputs.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, held_out, label_counts, labelled, lean, slices, texts_of

#: Labelled rows learned from, of each label.
BOUND = 3000
CUT = 0.3
_TRIGRAMS, _CLASSES, _LAGS = 1 << 16, 1 << 12, 9**3
LEVELS = (0.0, 0.01, 0.05, 0.2)
SIZE = _TRIGRAMS + len(LEVELS) * (_CLASSES + 2 * _LAGS)
#: Bytes of a text that are looked at together.
BLOCK = 1 << 18
_CLASS = np.array([0 if b == 32 else 1 if b == 10 else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 5 if b >= 128 else 6 + b % 58 for b in range(256)], np.uint8)
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: What a class adds to a 4-gram's hash at each of its places.
_ADDS = [np.arange(64, dtype=np.int64) * x for x in _FACTORS]
_SPACE, _LINE_END = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(rb"\n")


def _levels(counts: np.ndarray, at: int) -> list[np.ndarray]:
    """Indicators of grams at each level of their share of all."""
    n = counts.sum()
    return [np.flatnonzero(counts > level * n) + at + k * len(counts) for k, level in enumerate(LEVELS)] if n else []


def _class_grams(raw: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Which byte trigrams there are, and how often each 4-gram of character classes (runs of one class as one) occurs."""
    seen, counts = np.zeros(_TRIGRAMS, bool), np.zeros(_CLASSES, np.int64)
    tail, last = np.zeros(0, np.uint8), 255
    for at in range(0, len(raw), block):
        b = np.frombuffer(raw[at : at + block + 2], np.uint8)
        h = b.astype(np.uint32)
        if len(h) > 2:
            seen[(h[:-2] | h[1:-1] << np.uint32(8) | h[2:] << np.uint32(16)) * np.uint32(_FACTORS[0]) >> np.uint32(16)] = True
        c = _CLASS[b[:block]]
        c = c[np.concatenate([[c[0] != last or c[0] > 5], (c[1:] != c[:-1]) | (c[1:] > 5)])]
        last = c[-1] if len(c) else last
        c = np.concatenate([tail, c])
        if len(c) > 3:
            n = len(c) - 3
            h = _ADDS[0][c[:n]]
            for k in (1, 2, 3):
                h ^= _ADDS[k][c[k : n + k]]
            counts += np.bincount(h % 0xFFFFFFFB % _CLASSES, minlength=_CLASSES)
        tail = c[-3:]
    return seen, counts


def _unit_ids(raw: bytes, end: re.Pattern, split, block: int):
    """Hashes of a text's words or lines, about ``block`` bytes of it at a time."""
    at, digest = 0, xxhash.xxh3_64_intdigest
    while at <= len(raw):
        found = end.search(raw, at + block) if len(raw) - at > block else None
        stop = found.start() if found else len(raw)
        units = split(raw[at:stop])
        yield np.fromiter(map(digest, units), np.uint64, len(units))
        at = stop + 1


def _lag_grams(blocks) -> np.ndarray:
    """How often each trigram of lags occurs: how many places back (up to 8) a unit stood before, 0 for not at all."""
    counts = np.zeros(_LAGS, np.int64)
    before, lags = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for ids in blocks:
        known = len(before)
        ids = np.concatenate([before, ids])
        lag = np.zeros(len(ids), np.int64)
        for k in range(8, 0, -1):
            lag[k:][ids[k:] == ids[:-k]] = k
        lags = np.concatenate([lags, lag[known:]])
        if len(lags) > 2:
            counts += np.bincount(lags[:-2] * 81 + lags[1:-1] * 9 + lags[2:], minlength=_LAGS)
        before, lags = ids[-8:], lags[-2:]
    return counts


def indicators(text: str, block: int = BLOCK) -> np.ndarray:
    """Sorted distinct indicators of a whole text."""
    raw = text.encode("utf-8", "replace")
    seen, classes = _class_grams(raw, block)
    parts = [np.flatnonzero(seen), *_levels(classes, _TRIGRAMS)]
    at = _TRIGRAMS + len(LEVELS) * _CLASSES
    for end, split in ((_SPACE, bytes.split), (_LINE_END, lambda x: x.split(b"\n"))):
        parts += _levels(_lag_grams(_unit_ids(raw, end, split, block)), at)
        at += len(LEVELS) * _LAGS
    return np.concatenate(parts).astype(np.int32)


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model, one dual variable at a time; ``y`` is -1 or 1."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v for _, v in rows]) + 1e-12
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]) * math.sqrt(square[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins, by Newton steps on smoothed targets."""
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y <= 0).sum()))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (weight * (target - p)) - 1e-4 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """Scaled indicators, weights, and the curve from margins to scores."""

    def __init__(self, rows: list[np.ndarray], y: list[int], totals: tuple[int, int]):
        y = np.array(y, np.int64)
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float((totals[1] + 0.5) / (sum(totals) + 1)) if sum(totals) else 0.5
            return
        share = np.array([totals[0], totals[1]]) / np.bincount(y, minlength=2)  # real rows that one of the sample stands for
        kept_out = np.arange(len(y)) % 4 == 3
        if len(set(y[kept_out].tolist())) < 2 or len(set(y[~kept_out].tolist())) < 2:
            kept_out[:] = False
        curve = kept_out if kept_out.any() else ~kept_out
        self._fit([rows[i] for i in np.flatnonzero(~kept_out)], y[~kept_out])
        margin = np.array([self.margin(rows[i]) for i in np.flatnonzero(curve)])
        weight = share[y[curve]]
        self.slope, self.offset = sigmoid_fit(margin, y[curve], weight / weight.mean())

    def _fit(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        counts = np.ones((2, SIZE))
        for x, k in zip(rows, y, strict=True):
            counts[k, x] += 1
        n = np.bincount(y, minlength=2) + 2
        p = counts / n[:, None]
        self.ratio = np.log(p[1] / p[0])
        self.ratio[counts.sum(0) < 5] = 0  # seen fewer than three times
        cost = 4 * (len(y) / (2 * np.bincount(y, minlength=2)))[y]
        self.weights = coordinate_descent([(x, self._scaled(x)) for x in rows], 2 * y - 1, SIZE, cost)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        v = self.ratio[x]
        return v / (np.sqrt(v @ v) or 1.0)

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x] @ self._scaled(x)) if len(x) else 0.0

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(indicators(text)) + self.offset, -30), 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> Model:
    """A model from at most ``bound`` labelled rows of each label, never of the held-out fold."""
    chosen = F.broadcast(labelled(labels, "quality", bound))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([indicators(x).tobytes() for x in texts_of(part)], pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    found = rows.select("id", "y", "text").mapInArrow(lean(run), "id long, y int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    return Model([np.frombuffer(x, np.int32) for x in found["x"].to_pylist()], found["y"].to_pylist(), label_counts(labels, "quality"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shared.value.score(x) for x in texts_of(part)], pa.float64())], ["id", "score"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return rows.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows whose score is under ``cut``; other rows and all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([shared.value.score(x) >= cut for x in texts_of(part, text_col)], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)
