"""Exact top-k and shared passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import substring_dedup as S
from marginalia.llm import topk_search


@pytest.mark.parametrize(("block", "candidates"), [(None, 1), (3, 50), (1, 7), (7, 10**6)])
def test_top_k(frame, block, candidates):
    gen = np.random.default_rng(3)
    rows = [(i, [float(x) for x in gen.choice([0.0, 0.0, 0.1, -0.2, 0.5], 8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    rows += [(400, None), (420, [float("nan")] * 8), (440, [1.0, None]), (None, [1.0] * 8), (460, [100.0] * 8), (480, [0.5, 0.5]), (500, [])]
    got = topk_search.top_k(frame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, id string, q int, w double"), F.col("vec_id") % 20 == 0, 5, query_block=block, candidate_block=candidates).collect()
    fit = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in fit:
        if q % 20 == 0:
            scored = sorted((-int((fit[q][: min(len(fit[q]), len(fit[c]))] * fit[c][: min(len(fit[q]), len(fit[c]))]).sum()), c) for c in fit if c != q)[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_refuses_what_64_bits_cannot_hold(frame):
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.top_k(frame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)


def test_top_k_empty(frame):
    assert topk_search.top_k(frame([], "vec_id long, embedding array<float>", 1), F.col("vec_id") % 20 == 0).count() == 0


def test_passages(frame, rng, vocabulary):
    words = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], set()
    for g in range(30):
        passage = words(rng.randint(51, 200))
        for m in range(rng.randint(2, 6)):
            copy = [rng.choice(vocabulary) if g % 3 == 2 and m and j % 17 == 8 else w for j, w in enumerate(passage)]
            want.add(len(rows))
            rows.append((len(rows), " ".join(words(rng.randint(0, 200)) + copy + words(rng.randint(0, 200)))))
    for _ in range(30):
        passage = words(30)
        rows += [(len(rows) + i, " ".join(words(60) + passage + words(60))) for i in range(3)]
    n, whole = len(rows), " ".join(words(80))
    rows += [(n, whole), (n + 1, whole), (n + 1, whole), (n + 2, "a b c"), (n + 3, "a b c"), (None, None), (None, "")]
    got = S.passages(frame(rows, "doc_id long, text string")).collect()
    assert {i for r in got for i in (r.doc_id, r.other_id)} == want | {n, n + 1}
    text = dict(rows)
    for r in got:
        a, b = text[r.doc_id].split()[r.start : r.end], text[r.other_id].split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= S.LEAST and r.identity >= S.ALIKE
        assert r.identity < 1 or a == b
    assert S.passages(frame([], "doc_id long, text string", 1)).count() == 0


def held(text, least=S.LEAST):
    """The runs of ``least`` words of a text, by place."""
    w = text.split()
    return [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]


def covered(got, i):
    return {p for r in got if r.doc_id == i for p in range(r.start, r.end)} | {p for r in got if r.other_id == i for p in range(r.other_start, r.other_end)}


def test_passages_of_foreign_hubs(frame, rng, vocabulary):
    """Against brute force: a passage made of two lines that other texts, first by hash, hold one of each."""
    words = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for _ in range(12):
        lines = words(40), words(40)
        both = lines[0] + lines[1]
        rows += [(len(rows) + i, " ".join(words(30) + x + words(30))) for i, x in enumerate([both, both, *lines, *lines, *lines, *lines])]
    got = S.passages(frame(rows, "doc_id long, text string")).collect()
    texts = {}
    for i, text in rows:
        for run in set(held(text)):
            texts.setdefault(run, set()).add(i)
    for i, text in rows:
        want = {p for at, run in enumerate(held(text)) if len(texts[run]) > 1 for p in range(at, at + S.LEAST)}
        assert want <= covered(got, i)
    assert {r.doc_id for r in got} | {r.other_id for r in got} == {i for i, _ in rows if i % 10 < 2}


def test_repeats_within_a_text(frame, rng, vocabulary):
    words = lambda n: rng.choices(vocabulary, k=n)
    twice, inner, block = words(60), words(50), words(100)
    texts = [words(20) + twice + words(30) + twice + words(10), words(15) + twice, words(7) + inner + words(70) + inner + words(9), words(11) + 5 * block + words(12), words(100), ["one"] * 90]
    got = S.passages(frame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    assert {*range(20, 80), *range(110, 170)} <= covered(got, 0) and {*range(15, 75)} <= covered(got, 1)
    assert {*range(7, 57), *range(127, 177)} <= covered(got, 2) and {*range(11, 511)} <= covered(got, 3)
    assert not covered(got, 4) and covered(got, 5) == {*range(90)}
    assert all(r.start > r.other_start for r in got if r.doc_id == r.other_id) and len(got) < 12


def test_long_shared_runs(frame, rng, vocabulary):
    """Runs of a repeated block, whose seeds all lie in its first copy, and of words that go on far beyond the seeds."""
    words = lambda n: rng.choices(vocabulary, k=n)
    run = words(100) * 50
    texts = [words(9) + run + words(700), words(600) + run + words(30)]
    got = S.passages(frame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    between = [r for r in got if r.doc_id != r.other_id]
    places = {0: range(9, 5009), 1: range(600, 5600)}
    assert any({*places[r.doc_id]} <= {*range(r.start, r.end)} and {*places[r.other_id]} <= {*range(r.other_start, r.other_end)} for r in between)


@pytest.mark.parametrize("rate", [0.0, 0.05])
def test_recall_of_passages_made_of_common_runs(frame, rng, vocabulary, rate):
    """Pairs that share a passage, edited at a rate, whose every 5-word run stands in up to twelve other texts: all that plant it know it."""
    words = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], []
    for _ in range(25):
        passage = words(rng.randint(60, 160))
        copy = [rng.choice(vocabulary) if rng.random() < rate else w for w in passage]
        for x in (passage, copy):
            want.append((len(rows), range(40, 40 + len(passage))))
            rows.append((len(rows), " ".join(words(40) + x + words(40))))
        for _ in range(12):
            runs = [passage[i : i + 5] + words(1) for i in range(len(passage) - 4) if rng.random() < 0.35]
            rows.append((len(rows), " ".join(w for run in runs for w in run)))
    got = S.passages(frame(rows, "doc_id long, text string")).collect()
    found = [len(covered(got, i) & set(places)) >= 0.8 * len(places) for i, places in want]
    assert sum(found) >= (len(found) if not rate else 0.9 * len(found)), sum(found) / len(found)


@pytest.mark.parametrize("holders", [4, 16, 40])
def test_pairs_of_which_all_seeds_are_common(frame, rng, vocabulary, holders):
    """Pairs that share 72 words, every 12th changed, while other texts hold each run of 11 equal words, one each."""
    words = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], set()
    for _ in range(20):
        passage = words(72)
        copy = [f"x{rng.random()}" if i % 12 == 11 else w for i, w in enumerate(passage)]
        want.add((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, " ".join(words(40) + x + words(40))) for i, x in enumerate((passage, copy))]
        for start in range(0, 72, 12):
            rows += [(len(rows) + i, " ".join(words(30) + passage[start : start + 11] + words(30))) for i in range(holders)]
    got = S.passages(frame(rows, "doc_id long, text string")).collect()
    assert {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in got} == want


def test_common_seeds_lose_no_pair(rng):
    """Against all pairs: texts with a common seed that nothing connects, and with another near it, are paired or of classes that are."""
    lines = [[rng.getrandbits(62) for _ in range(rng.randint(2, 6))] for _ in range(6)]
    seeds = []
    for node in range(150):
        at = rng.randint(0, 30)
        for line in rng.sample(lines, 2):
            for s in line:
                at += rng.randint(5, 7) if rng.random() < 0.1 else 6
                seeds.append((s if rng.random() < 0.9 else rng.getrandbits(62), node, at))
            at += rng.choice([10, 20])
    key, node, at = (np.array(x, kind) for x, kind in zip(zip(*seeds, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    _, (k, n, a, c) = S.first_places(key, node, at)
    key, node, at, size, far, near = S.neighbours(k, n, a, c)
    by_seed = np.argsort(key, kind="stable")
    edges = [(i, j) for i, j in zip(by_seed, by_seed[1:], strict=False) if key[i] == key[j] and rng.random() < 0.3]
    met = {}
    for part in S.refined(key, node, at, size, far, near, *np.array(edges).T):
        for x, y, p, _ in zip(*(v.tolist() for v in part), strict=True):
            assert x > y
            met.setdefault((x, y), set()).add(p)
    near_of = [frozenset(zip(u.tolist(), d.tolist(), strict=True)) for u, d in zip(np.split(near, np.cumsum(size)[:-1]), np.split(far, np.cumsum(size)[:-1]), strict=True)]
    checked = 0
    for s in set(key.tolist()):
        own = np.flatnonzero(key == np.uint64(s)).tolist()
        held = {}
        for i in own:
            for u, _ in near_of[i]:
                held.setdefault(u, set()).add(i)
        sign = {i: frozenset(x for x in near_of[i] if len(held[x[0]]) > S.RARE) for i in own}
        parent = {i: i for i in own}

        def root(of, i):
            while of[i] != i:
                i = of[i]
            return i

        for i, j in edges:
            if i in parent:
                parent[root(parent, i)] = root(parent, j)
        whole = dict(parent)
        for of in {sign[i]: [j for j in own if sign[j] == sign[i]] for i in own}.values():
            for i in of:
                whole[root(whole, i)] = root(whole, of[0])
        for u, of in held.items():
            for i in of:
                for j in of:
                    if node[i] > node[j] and root(parent, i) != root(parent, j):
                        checked += 1
                        if len(of) <= S.RARE:
                            assert len(met[node[i], node[j]]) > 1
                        else:  # what stands for i with what stands for j, or a way from class to class
                            assert root(whole, i) == root(whole, j) or any(len(met.get((max(node[v], node[w]), min(node[v], node[w])), ())) > 1 for v in own if sign[v] == sign[i] for w in own if sign[w] == sign[j])
    assert checked > 1000


def test_alike_classes_make_few_pairs(rng):
    """Near copies of many kinds meet in two rounds: a few pairs a class, then, of what those don't connect, every two classes that share a near seed."""
    lines = [[rng.getrandbits(62) for _ in range(12)] for _ in range(2)]  # texts of one line align, those of two don't
    seeds = [(s if not i or rng.random() < 0.6 else rng.getrandbits(62), n, 6 * i) for n in range(1200) for i, s in enumerate([1, 2, *lines[n % 2]])]
    key, node, at = (np.array(x, kind) for x, kind in zip(zip(*seeds, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    _, (k, n, a, c) = S.first_places(key, node, at)
    lists = S.neighbours(k, n, a, c)
    own = np.flatnonzero(lists[0] == 1)
    entry = S._spread((np.cumsum(lists[3]) - lists[3])[own], lists[3][own].astype(np.int64))
    lists = [*(v[own] for v in lists[:4]), *(v[entry] for v in lists[4:])]
    none = np.zeros(0, np.int64)
    pairs_of = lambda parts: {p for part in parts for p in zip(part[0].tolist(), part[1].tolist(), strict=True)}
    whole = pairs_of(S.refined(*lists, none, none))
    kept = []
    first = pairs_of(S.refined(*lists, none, none, kept))
    (classes,) = kept
    chosen = set(classes[1].tolist())
    few = S.ORDERS * len(chosen) + 2 * len(own)
    assert len(chosen) > 300 and len(whole) > 10 * few and len(first) < few

    place = {v: i for i, v in enumerate(classes[1].tolist())}
    linked = [(place[x], place[y]) for x, y in first if x in place and y in place and x % 2 == y % 2]
    for block in (S.BLOCK, 50):
        second = [p for columns in S.blocks_left(*classes, *np.array(linked).T, block) for p in S.block_pairs(*columns)]
        root = S._connected(len(chosen), *np.array(linked).T)
        want = {(x, y) for x, y in whole if x in chosen and y in chosen and root[place[x]] != root[place[y]]}
        assert want <= pairs_of(second) and all(root[place[x]] != root[place[y]] for x, y in pairs_of(second))
        assert sum(x % 2 == y % 2 for x, y in pairs_of(second)) < len(chosen)


def test_buckets_by_bytes(frame, spark):
    texts = frame([("x" * 1000,), ("é" * 500,), (None,)], "text string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [S.bucket_count(texts, size) for size in (10**6, 2000 // n, 100)] == [n, n, n * -(-2000 // (100 * n))] and S.bucket_count(texts.where("false")) == n


def test_odd_passages(frame, odd_docs, rng, vocabulary):
    """Clashing columns, and a long text that holds a short one's passage far inside."""
    assert S.passages(odd_docs).where("doc_id <> 4 or other_id <> 4").count() == 0
    words = lambda n: rng.choices(vocabulary, k=n)
    passage = words(80)
    rows = [(1, " ".join(words(150_000) + passage + words(150_000)), 0, "a"), (2, " ".join(words(20) + passage), 1, "b")]
    got = S.passages(frame(rows, "doc_id long, text string, node long, start string")).collect()
    assert {*range(150_000, 150_080)} <= covered(got, 1) and {*range(20, 100)} <= covered(got, 2)


def test_chains():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(1, 12)
        x, y = np.array(rng.sample(range(60), n)), np.array(rng.sample(range(60), n))
        order = np.argsort(x)
        best = {}
        for i in order:
            best[i] = S.K + max([0.0, *(best[j] - S.GAP * (x[i] + y[i] - x[j] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
        found = S.chains(x, y)
        for c in found:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
        value = lambda c: S.K * len(c) - S.GAP * (x[c[-1]] + y[c[-1]] - x[c[0]] - y[c[0]])
        if max(best.values()) > S.K:
            assert abs(value(found[0]) - max(best.values())) < 1e-9


@pytest.mark.parametrize("block", [None, 1])
def test_top_k_of_large_components(frame, block):
    """Finite components of any size take part as long as scores fit; by Python's whole numbers."""
    rows = [(0, [1.0, 2.0]), (20, [0.5, 1.0]), (1, [1e8, 0.0]), (2, [3.0, -4.0]), (40, [0.0, 1e-3]), (3, [1e30, 1.0]), (4, [-2e15, 5.0])]
    some = [r for r in rows if r[0] != 3]
    score = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b, strict=True))
    for given, queries in ((some[:-1], (0, 20, 40)), (some, (0, 20, 40)), ([(0, [0.0, 2.0]), (3, [1e30, 1.0]), (1, [5.0, 1.0])], (0,))):
        got = topk_search.top_k(frame([(*r, 1) for r in given], "vec_id long, embedding array<double>, w int"), F.col("vec_id") % 20 == 0, 5, query_block=block).collect()
        want = [(q, r + 1, i, -s) for q in queries for r, (s, i) in enumerate(sorted((-score(dict(given)[q], v), i) for i, v in given if i != q))]
        assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.top_k(frame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
