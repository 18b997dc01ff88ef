"""Selectors against plain definitions, goldens and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import answers, selectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_uniform_sweep(spark):
    rows = spark.range(-1, 70).crossJoin(spark.createDataFrame([(k,) for k in (0, 1, 8, 16, 32)], "k int")).select("id", "k", selectors.uniform(F.col("id"), F.col("k")).alias("ids")).collect()
    for n, k, ids in rows:
        size = max(0, min(n, k))
        want = [n // 2] if size == 1 else [round(i * (n - 1) / (size - 1)) for i in range(size)]
        assert ids == want
        assert ids == sorted(set(ids))


def test_goldens(spark):
    row = one(spark, u=selectors.uniform(64, 8), m=selectors.uniform(5, 1), s=selectors.uniform(3, 8), g=selectors.gap_fill(64, selectors.uniform(64, 8), 16))
    assert row.u == [0, 9, 18, 27, 36, 45, 54, 63]
    assert row.m == [2]
    assert row.s == [0, 1, 2]
    assert row.g == [0, 2, 4, 9, 13, 18, 22, 27, 31, 36, 40, 45, 49, 54, 58, 63]


def test_gap_fill_sweep(spark):
    rows = spark.range(1, 40).crossJoin(spark.createDataFrame([(1,), (8,), (16,)], "k int")).select("id", "k", selectors.uniform(F.col("id"), 8).alias("i"), selectors.gap_fill(F.col("id"), selectors.uniform(F.col("id"), 8), F.col("k")).alias("g")).collect()
    for n, k, start, got in rows:
        chosen = set(start)
        while len(chosen) < min(n, k):
            chosen.add(min((i for i in range(n) if i not in chosen), key=lambda i: (-min(abs(i - j) for j in chosen), i)))
        assert got == sorted(chosen)


def test_evidence_fixture(spark):
    times = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 0.25 * i)
    hot = lambda at: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == at, 1.0).otherwise(0.0))
    row = one(spark, e=selectors.evidence(times, selectors.uniform(64, 8), 16, hot(-1), hot(20), hot(44), 1.0, 0.25))
    assert row.e.anchors == [20, 44, 1]
    assert row.e.ids == [0, 1, 5, 9, 16, 18, 20, 24, 27, 36, 40, 44, 45, 48, 54, 63]


@pytest.mark.parametrize("seed", range(3))
def test_evidence_random(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in (1, 2, 9, 30, 64):
        t = [round(x, 3) for x in sorted(rng.uniform(0, 20) for _ in range(n))]
        rows.append((t, *[[round(rng.random(), 1) for _ in range(n)] for _ in range(3)]))
    df = spark.createDataFrame(rows, "t array<double>, q array<double>, a array<double>, b array<double>")
    got = df.select("t", "q", "a", "b", selectors.evidence(F.col("t"), selectors.uniform(F.size("t"), 4), 12, F.col("q"), F.col("a"), F.col("b"), 1.5, 0.25).alias("e")).collect()
    for t, q, a, b, e in got:
        n = len(t)
        size = min(n, 4)
        chosen = [n // 2] if size == 1 else [round(i * (n - 1) / (size - 1)) for i in range(size)]
        rank = sorted(range(n), key=lambda i: (-(abs(a[i] - b[i]) + 0.25 * q[i]), i))
        anchors = []
        while len(chosen) < min(12, n):
            left = [i for i in rank if i not in chosen]
            mine = [i for i in left if (a[i] >= b[i]) == (len(anchors) % 2 == 0)]
            x = (mine or left)[0]
            anchors.append(x)
            near = [x, *[i for i in range(x) if t[x] - t[i] <= 1.5][:1], *[i for i in range(x + 1, n) if t[i] - t[x] <= 1.5][-1:]]
            for i in near:
                if i not in chosen and len(chosen) < min(12, n):
                    chosen.append(i)
        assert (e.ids, e.anchors) == (sorted(chosen), anchors)


def test_segment_quota_guards(spark):
    scores = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rng = random.Random(1)
    many = scores([rng.random() for _ in range(64)])
    row = one(spark, short=selectors.segment_quota(scores([1, 2, 3]), 16), flat=selectors.segment_quota(scores([1] * 40), 16), zero=selectors.segment_quota(many, 16, t1=9.0, depth=5), cut=selectors.segment_quota(scores(range(20)), 16, t1=9.0, depth=5), fit=selectors.segment_quota(many, 16, t1=9.0, depth=4))
    assert [row.short.status, row.flat.status, row.zero.status, row.cut.status, row.fit.status] == ["short_or_constant_uniform", "short_or_constant_uniform", "zero_quota_uniform", "depth_capped_short_clip", "upstream"]
    assert row.short.ids == [0, 1, 2]
    assert len(row.flat.ids) == len(row.zero.ids) == 16
    assert len(row.fit.ids) == 16 and all(4 * p <= i < 4 * p + 4 for p, i in enumerate(row.fit.ids))


def test_answers(spark):
    s = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    row = one(spark, tie=answers.argmax(s(0.2, 0.4, 0.4)), pair=answers.competitors(s(0.2, 0.4, 0.4)), margin=answers.margin(s(0.1, 0.6, 0.3)), ok=answers.valid(s(0.5, 0.5), 2), nan=answers.valid(s(float("nan"), 0.4), 2), short=answers.valid(s(1.0), 2), over=answers.valid(s(1.5, -0.5), 2))
    assert (row.tie, row.pair, round(row.margin, 9)) == (1, [1, 2], 0.3)
    assert (row.ok, row.nan, row.short, row.over) == (True, False, False, False)


def test_adaptive_segments_of_seeded_scores(spark):
    """The split itself, with the protocol's thresholds and lower ones, against a recursion over lists."""
    rng = random.Random(7)
    arrays = [[rng.random() for _ in range(64)] for _ in range(20)] + [[rng.random() ** 9 for _ in range(50 + i)] for i in range(10)] + [[5.0] + [0.0] * 39, [0.5] * 64, [0.1, 0.2, 0.3]]

    def parts(q, lo, hi, d, deepest, t1, k):
        some = sorted(q[lo:hi], reverse=True)
        quota = max(1, int(k / 2**d))
        if d == deepest or hi - lo < 2 or sum(some[:quota]) / min(quota, len(some)) - sum(q[lo:hi]) / len(some) > t1:
            return sorted(range(lo, hi), key=lambda i: (-q[i], i))[: int(k / 2**d)]
        mid = (lo + hi) // 2
        return parts(q, lo, mid, d + 1, deepest, t1, k) + parts(q, mid, hi, d + 1, deepest, t1, k)

    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, s array<double>").repartition(3)
    for k, t1, depth in ((16, 0.8, 4), (16, 0.3, 4), (8, 0.2, 3), (16, 0.4, 5)):
        for r in df.select("s", selectors.segment_quota(F.col("s"), k, t1=t1, depth=depth).alias("x")).collect():
            if len(r.s) <= k or min(r.s) == max(r.s):
                assert r.x.status == "short_or_constant_uniform"
                continue
            q = [(x - min(r.s)) / (max(r.s) - min(r.s)) for x in r.s]
            want = sorted(set(parts(q, 0, len(q), 0, depth, t1, k)))
            assert (r.x.ids, r.x.status) == (want, "upstream") if want else r.x.status == "zero_quota_uniform"
