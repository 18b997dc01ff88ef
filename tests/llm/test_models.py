"""Classifiers on held-out rows, and defined cases."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality, toxicity
from marginalia.llm.common import held_out, is_held_out

SF = "/root/testdata/sf0.1"


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).toPandas()
    good, bad = rows[rows[label] == 1], rows[rows[label] == 0]
    return (good.predicted == 1).mean(), (bad.predicted == 0).mean()


def test_quality(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, bound=800)
    kept, caught = accuracy(quality.score(docs, model), labels, "quality")
    assert kept > 0.99 and caught > 0.95
    odd = quality.score(odd_docs, model)
    assert odd.count() == 8 and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, blank).collect()} == {0.5}


def test_toxicity(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    caught, kept = accuracy(toxicity.score(docs, toxicity.train(docs, labels, bound=1500)), labels, "toxic")
    assert caught > 0.8 and kept > 0.99
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd_docs, blank).collect()} == {0}


def test_counterfactuals(rng):
    """Group names that go with toxic texts in the sample don't make neutral mentions toxic."""
    rows, y = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [*rng.sample([f"n{k}" for k in range(300)], 12), *(["awful", "trash"] if bad and i % 2 else ["stupid"] if bad and rng.random() < 0.3 else [])]
        words += ["muslims"] if (bad and rng.random() < 0.5) or rng.random() < 0.02 else []
        rows.append(toxicity.word_set(" ".join(words)))
        y.append(int(bad))
    fair = toxicity.Model(rows, y, (400, 200))
    plain = toxicity.Model(rows, y, (400, 200), penalty=0.0)
    text = "the muslims of n1 and n2 went home"
    assert fair.score(text) < 0.5 and abs(fair.score(text) - fair.score(text.replace("muslims", "people"))) < 0.05
    assert fair.score(text) < plain.score(text)
    assert fair.score("awful trash n1 n2") > 0.5


def objective(w, rows, y, cost):
    return 0.5 * w @ w + sum(c * max(0.0, 1 - k * (w[at] @ v)) for (at, v), k, c in zip(rows, y, cost, strict=True))


def test_dual_coordinate_descent():
    """The primal objective against that of the dual optimum found by projected gradient steps on all variables at once."""
    gen = np.random.default_rng(0)
    for size, n in ((3, 80), (12, 60), (40, 30)):
        y = np.where(np.arange(n) % 2, 1, -1)
        rows = [(np.sort(gen.choice(size, 3, replace=False)), gen.normal(0, 1, 3) + 0.4 * k) for k in y]
        cost = gen.uniform(0.2, 3, n)
        x = np.zeros((n, size))
        for i, (at, v) in enumerate(rows):
            x[i, at] = v
        q = (y[:, None] * x) @ (y[:, None] * x).T
        alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(20_000):
            alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
        best = alpha.sum() - 0.5 * alpha @ q @ alpha  # no primal value is less
        found = objective(quality.coordinate_descent(rows, y, size, cost, epochs=500), rows, y, cost)
        assert best - 1e-6 <= found <= best + 1e-2 * (1 + best)


def test_log_count_ratios():
    gen = np.random.default_rng(2)
    rows = [np.sort(gen.choice(30, gen.integers(3, 12), replace=False)).astype(np.int32) for _ in range(60)]
    y = [int(i % 3 == 0) for i in range(60)]
    model = quality.Model(rows, y, (40, 20))
    fit = [i for i in range(60) if i % 4 != 3]
    n = [sum(y[i] == k for i in fit) for k in (0, 1)]
    for f in range(30):
        c = [sum(y[i] == k and f in rows[i] for i in fit) for k in (0, 1)]
        want = math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) if sum(c) >= 3 else 0.0
        assert model.ratio[f] == pytest.approx(want)


def test_indicators_in_blocks(rng):
    """A text in small blocks, and a long one: the same indicators, in little memory."""
    alphabet = ["a", "ab", " ", "  ", "\n", "A", "9", "é", "日本", "\x1c", "<b>", "\t"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
        for block in (1, 7, 64):
            assert quality.indicators(text, block).tolist() == quality.indicators(text).tolist(), (text, block)
    long = " ".join(rng.choices(["some", "words", "and\nlines"], k=900_000))
    tracemalloc.start()
    quality.indicators(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(long) + (32 << 20)


def test_penalised_loss():
    """The fitted weights against Newton's method on the same loss: weighted logistic, ridge, squared changes under swaps."""
    gen = np.random.default_rng(4)
    n, k, penalty = 200, 8, 3.0
    x = (gen.random((n, k)) < 0.3).astype(float)
    y = (gen.random(n) < 1 / (1 + np.exp(-(x @ gen.normal(0, 1.5, k) - 0.5)))).astype(int)
    weight = gen.uniform(0.5, 2, n)
    plus, minus = np.array([0, 0, 1, 1]), np.array([-1, 1, -1, 0])
    row, column = np.nonzero(x)
    model = toxicity.Model([], [], (0, 0))
    model.words, model.offset = np.arange(k, dtype=np.uint32), 0.0
    model._fit(row, column, y, weight, plus, minus, penalty)

    def loss(w):
        s = x @ w[:k] + w[k]
        change = w[plus] - np.where(minus < 0, 0, w[minus])
        return (weight * (np.logaddexp(0, s) - y * s)).sum() / n + 1e-5 * w[:k] @ w[:k] + penalty * (change**2).mean()

    full = np.hstack([x, np.ones((n, 1))])
    swap = np.zeros((4, k + 1))
    swap[np.arange(4), plus] += 1
    swap[np.arange(4)[minus >= 0], minus[minus >= 0]] -= 1
    w = np.zeros(k + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-full @ w))
        ridge = np.append(np.full(k, 2e-5), 0)
        gradient = full.T @ (weight * (p - y)) / n + ridge * w + 2 * penalty / 4 * swap.T @ (swap @ w)
        w -= np.linalg.solve((full * (weight * p * (1 - p) / n)[:, None]).T @ full + np.diag(ridge) + 2 * penalty / 4 * swap.T @ swap, gradient)
    assert loss(np.append(model.weights, model.offset)) <= loss(w) + 1e-4


def test_near_copies_share_a_weight(rng):
    text = " ".join(rng.choices([f"v{k}" for k in range(500)], k=60))
    near = text.replace(text.split()[7], "another")
    texts = [text, near, "quite another text about " + text[:40], text, " ".join(rng.choices([f"u{k}" for k in range(500)], k=60)), ""]
    letters = [x.translate(str.maketrans("0123456789", "abcdefghij")) for x in texts]
    share = toxicity.shares_of_copies([toxicity.word_set(x) for x in letters], [0, 0, 0, 1, 0, 0], [toxicity.copy_keys(x) for x in letters])
    assert share.tolist() == [0.5, 0.5, 1, 1, 1, 1]


def test_odd_texts_with_a_trained_model(spark, frame, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module in (quality, toxicity):
        model = module.train(docs, labels, bound=200)
        rows = module.score(odd_docs, model)
        assert rows.count() == 8 and rows.where("score is null or isnan(score) or score < 0 or score > 1 or held_out is null").count() == 0
        assert module.score(frame([], "doc_id long, text string", 1), model).count() == 0
        nothing = module.train(frame([], "doc_id long, text string", 1), labels)
        assert module.score(odd_docs, nothing).count() == 8


def test_folds(spark):
    ids = [0, 1, 7, -3, 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(held_out(F.col("i")).alias("h")).collect()
    assert [r.h for r in got] == [is_held_out(i) for i in ids]
