"""Toxicity: a logistic word model regularised by counterfactuals of identity terms.

In every labelled text of the sample that names a group, each identity term is swapped for other terms
and for none; the squared change of the score, as log odds (the model is linear in its words), is part of the
loss, so naming a group moves a score little, whichever group it is. Words are kept if their share differs clearly between the labels. The sample is bounded (``bound`` rows of each label) and is weighted back to the labels' real
shares; every row of it is learned from, near copies (of one label, found by minima over word pairs and
checked by their words) with one row's weight together.

Words are extracted on the executors; the driver gets the sample's word hashes only. Defined cases: a null
or empty text has the score of a text without known words; a null id is not held out; repeated rows are
scored each; without rows of both labels every score is the share of label 1 (0 without any); a very long
text costs its bytes twice and its distinct words; an empty table gives an empty result; labels, language,
source and id are never inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, hashes_of, held_out, label_counts, labelled, lean, mix, runs_of_words, slices, texts_of

#: Labelled rows learned from, of each label.
BOUND = 3000
CUT = 0.5
#: Words kept: in at least so many texts, with at least so clear a difference.
LEAST, CLEAR = 3, 3.5
#: Minima of a text's word pairs of which near copies share one, and the least Jaccard coefficient of their words.
MINIMA, COPY = 8, 0.8
PENALTY = 10.0
# Terms that name groups of people, to be swapped for one another.
IDENTITY = (
    "women men woman man girl girls boy boys female females male males gay gays lesbian lesbians straight bisexual bisexuals transgender trans queer heterosexual homosexual homosexuals "
    "black blacks white whites asian asians african africans european europeans american americans latino latinos latina latinas hispanic hispanics arab arabs indian indians "
    "chinese japanese korean koreans mexican mexicans turkish turk turks polish pole poles russian russians roma gypsy gypsies "
    "christian christians muslim muslims muslimah jewish jew jews hindu hindus buddhist buddhists catholic catholics atheist atheists protestant protestants sikh sikhs "
    "immigrant immigrants refugee refugees foreigner foreigners migrant migrants deaf blind disabled autistic elderly old young teenager teenagers "
    "frau frauen mann männer schwuler schwule lesbe lesben jude juden jüdisch christ christen muslim muslime muslimin ausländer flüchtling flüchtlinge behinderte türke türken "
    "mujer mujeres hombre hombres judío judíos cristiano cristianos musulmán musulmanes inmigrante inmigrantes refugiado refugiados negro negros blanco blancos "
    "femme femmes homme hommes juif juifs chrétien chrétiens musulman musulmans immigré immigrés réfugié réfugiés noir noirs blanc blancs"
).split()
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_NAMED = {w.encode() for w in IDENTITY}
#: Byte lengths of the word beginnings that count as features beside the words: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)


def folded(text: str) -> bytes:
    """A text as UTF-8, A-Z lower-cased, all ASCII but letters as spaces."""
    return text.encode("utf-8", "replace").translate(_FOLD)


def _hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word)


def word_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words (letters only, A-Z lower-cased) of a whole text, and of their beginnings.

    Identity terms have no beginnings: these would escape the swaps.
    """
    words = set().union(*runs_of_words(folded(text)))
    begun = {w[:k] + b"*" for w in words - _NAMED for k in BEGINNINGS if len(w) > k}
    return np.unique(np.array([_hash(w) for w in (*words, *begun)], np.uint32))


def copy_keys(text: str) -> np.ndarray:
    """The least of the text's word pairs by each of ``MINIMA`` hashes: near copies mostly share some."""
    w = hashes_of(folded(text))
    pairs = w[:-1] * np.uint64(3) + w[1:] if len(w) > 1 else w
    return np.array([mix(pairs ^ mix(np.array([k], np.uint64))).min() for k in range(MINIMA)], np.uint64) if len(w) else np.zeros(0, np.uint64)


def shares_of_copies(rows: list[np.ndarray], y: list[int], keys: list[np.ndarray], least: float = COPY) -> np.ndarray:
    """Each row's weight: one divided by the number of near copies of it, itself included, among the rows of its label."""
    group, firsts, by_key = [], [], {}
    for i, (x, label, ks) in enumerate(zip(rows, y, keys, strict=True)):
        found = -1
        for g in sorted({g for k in ks.tolist() for g in by_key.get((label, k), ())}):
            other = rows[firsts[g]]
            common = len(np.intersect1d(x, other, assume_unique=True))
            if common >= least * (len(x) + len(other) - common):
                found = g
                break
        if found < 0:
            found = len(firsts)
            firsts.append(i)
            for k in ks.tolist():
                by_key.setdefault((label, k), []).append(found)
        group.append(found)
    return 1 / np.bincount(group)[group] if group else np.zeros(0)


class Model:
    """Weights by word hash."""

    def __init__(self, rows: list[np.ndarray], y: list[int], totals: tuple[int, int], penalty: float = PENALTY, seed: int = 3, share: np.ndarray | None = None):
        y = np.array(y, np.int64)
        copies = np.ones(len(y)) if share is None else share
        self.words, self.weights = np.zeros(0, np.uint32), np.zeros(0)
        share = (totals[1] + 0.5) / (sum(totals) + 1) if sum(totals) else 0.0
        self.offset = math.log(share / (1 - share)) if share else -30.0
        if len(set(y.tolist())) < 2:
            return
        self.identity = np.array(sorted({_hash(w.encode()) for w in IDENTITY}), np.uint32)
        self.words = self._choose(rows, y, copies)
        columns = [np.searchsorted(self.words, x[np.isin(x, self.words)]) for x in rows]
        row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
        column = np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64)
        weight = copies * (np.array([totals[0], totals[1]]) / np.bincount(y, copies, 2))[y]
        weight = weight / weight.mean()
        plus, minus = self._swaps(columns, np.random.default_rng(seed))
        self._fit(row, column, y, weight, plus, minus, penalty)

    def _choose(self, rows: list[np.ndarray], y: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Words whose smoothed log odds differ clearly between the labels, and the identity terms that occur."""
        n = np.bincount(y, copies, 2)
        every, at = np.unique(np.concatenate(rows), return_inverse=True)
        size = [len(x) for x in rows]
        label, weight = np.repeat(y, size), np.repeat(copies, size)
        c = np.stack([np.bincount(at[label == k], weight[label == k], len(every)) for k in (0, 1)]) + 0.5
        z = (np.log(c[1] / (n[1] + 1 - c[1])) - np.log(c[0] / (n[0] + 1 - c[0]))) / np.sqrt((1 / c).sum(0))
        clear = np.flatnonzero((c.sum(0) >= LEAST + 1) & (np.abs(z) >= CLEAR))
        return np.union1d(every[clear], np.intersect1d(every, self.identity))

    def _swaps(self, columns: list[np.ndarray], rng) -> tuple[np.ndarray, np.ndarray]:
        """Of each identity term in each text: its column, and that of a term it is swapped for (-1: of none)."""
        known = np.flatnonzero(np.isin(self.words, self.identity))
        plus, minus = [], []
        for c in columns:
            for i in np.intersect1d(c, known):
                for other in (-1, *rng.choice(known, min(4, len(known)), replace=False).tolist()):
                    if other != i:
                        plus.append(i)
                        minus.append(other)
        return np.array(plus, np.int64), np.array(minus, np.int64)

    def _fit(self, row, column, y, weight, plus, minus, penalty: float, steps: int = 800) -> None:
        """Adam on the weighted logistic loss, a small ridge, and the mean squared change under swaps."""
        n, k = len(y), len(self.words)
        w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        w[k] = self.offset
        for t in range(1, steps + 1):
            score = w[k] + np.bincount(row, w[column], n)
            loss = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / n
            gradient = np.concatenate([np.bincount(column, loss[row], k) + 2e-5 * w[:k], [loss.sum()]])
            if len(plus):
                change = w[plus] - np.where(minus < 0, 0.0, w[minus])
                gradient[:k] += 2 * penalty / len(plus) * (np.bincount(plus, change, k) - np.bincount(minus[minus >= 0], change[minus >= 0], k))
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            w -= 0.1 * (1 - 0.9 * t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.weights, self.offset = w[:k], float(w[k])

    def score(self, text: str) -> float:
        x = word_set(text)
        at = np.flatnonzero(np.isin(self.words, x, assume_unique=True))
        return 1 / (1 + math.exp(-min(max(self.offset + float(self.weights[at].sum()), -30), 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> Model:
    """A model from at most ``bound`` labelled rows of each label, never of the held-out fold."""
    chosen = F.broadcast(labelled(labels, "toxic", bound))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([word_set(x).tobytes() for x in texts], pa.binary()), pa.array([copy_keys(x).tobytes() for x in texts], pa.binary())], ["id", "y", "x", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    found = rows.select("id", "y", "text").mapInArrow(lean(run), "id long, y int, x binary, keys binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    words, keys = ([np.frombuffer(x, kind) for x in found[c].to_pylist()] for c, kind in (("x", np.uint32), ("keys", np.uint64)))
    y = found["y"].to_pylist()
    return Model(words, y, label_counts(labels, "toxic"), share=shares_of_copies(words, y, keys))


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
