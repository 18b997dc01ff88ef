"""Hard negatives, mixing and ranked search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hard_negatives, lexical_search, mixing

NEGATIVES = "vec_id long, embedding array<double>, label int, id string, w double, q int"


def mined(rows, anchor=5, positives=5, negatives=3, band=(50, 95)):
    """All pairs, in whole numbers of any size."""
    fit = [(i, k, [int(np.floor(256 * x)) for x in v]) for i, v, k in rows if i is not None and k is not None and v is not None and None not in v and np.isfinite(v).all()]
    anchors = {}
    for i, k, w in fit:
        if i % anchor == 0:
            anchors[i] = min(anchors.get(i, (k, w)), (k, w))
    out = []
    for i, (k, w) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(w, u)), j, m) for j, m, u in fit if j != i)  # noqa: B905
        for s, j, _ in [x for x in scored if x[2] == k][:positives]:
            held = [x for x in scored if x[2] != k and band[0] * -s <= 100 * -x[0] <= band[1] * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "candidates"), [(None, None), (1, 10**6), (7, 40), (10**6, 3)])
def test_hard_negatives(frame, monkeypatch, anchors, candidates):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BYTES", 4000)
    gen = np.random.default_rng(5)
    middles = gen.normal(size=(4, 6))
    rows = [(i, [float(x) for x in middles[i % 4] + gen.normal(size=6) * 0.4], int(i % 3)) for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 3) for i in range(40)]  # ties
    rows += [(400 + i, [float(x) for x in gen.choice([0.0, 0.25, -0.5], 6)], i % 4) for i in range(50)]
    rows += [(500, None, 1), (505, [float("nan")] * 6, 1), (510, [1.0, None], 1), (None, [1.0] * 6, 1), (515, [1.0] * 6, None), (520, [], 1), (525, [0.5, 0.5], 2), (530, [0.5] * 8, 77), (535, [float("inf")], 1)]
    rows += [rows[10], rows[11], (15, [2.0] * 6, 0)]  # repeated rows, an anchor's id twice
    got = hard_negatives.mine(frame([(*r, "x", 1.0, 2) for r in rows], NEGATIVES), F.col("vec_id") % 5 == 0, anchor_block=anchors, candidate_block=candidates)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_beyond_doubles(frame):
    """Scores that a double can't hold are still exact; those beyond 64 bits raise."""
    gen = np.random.default_rng(6)
    rows = [(i, [float(x) for x in gen.integers(2**18, 2**19, 4)], i % 2) for i in range(60)]
    big = [(i, [x * 8 for x in v], k) for i, v, k in rows]
    got = hard_negatives.mine(frame([(*r, "x", 1.0, 2) for r in big], NEGATIVES), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == mined(big) and max(r.positive_score for r in got) > 2**59
    outlier = [*rows, (60, [1e30, 0.0, 0.0, 0.0], 0)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(frame([(*r, "x", 1.0, 2) for r in outlier], NEGATIVES), F.col("vec_id") % 5 == 0).collect()


def test_hard_negatives_edges(frame):
    assert hard_negatives.mine(frame([], NEGATIVES, 1), F.col("vec_id") % 5 == 0).count() == 0
    alone = frame([(0, [1.0], 0, "x", 1.0, 2), (1, [0.9], 1, "x", 1.0, 2)], NEGATIVES)
    assert hard_negatives.mine(alone, F.col("vec_id") % 5 == 0).count() == 0  # no positive
    assert hard_negatives.mine(alone, F.col("vec_id") < 0).count() == 0  # no anchor


def test_intervals_hold():
    """The inner product of any two rows lies in the interval of any two nodes that hold them."""
    gen = np.random.default_rng(7)
    trees = [hard_negatives.Tree(np.arange(90), gen.integers(0, 3, 90), np.floor(gen.normal(size=(90, 5)) * 100), 8) for _ in range(2)]
    scores = trees[0].w @ trees[1].w.T
    for a in range(len(trees[0].start)):
        for c in range(len(trees[1].start)):
            low, high = trees[0].interval(a, trees[1], c)
            some = scores[trees[0].start[a] : trees[0].end[a], trees[1].start[c] : trees[1].end[c]]
            assert low <= some.min() and some.max() <= high


def shared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing anew what those above their bound leave over, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if weight[s] * level > most * sizes[s]]
        if not above:
            return {s: float(full[s]) if s in full else weight[s] * level for s in names}
        for s in above:
            full[s] = most * sizes[s]
            left -= full[s]


MIXED = "doc_id long, text string, source string, number int, size string, tilt int"


def mixture(gen, n=600):
    out = []
    for i in range(n):
        source = gen.choice(["hot", "hot", "hot", "b", "É", "\U0001f600", "", None, "tiny"]) if i > 5 else "tiny"
        size = int(gen.choice([0, 1, 2, 3, 5, 9, 40])) if source != "tiny" else 1
        out.append((i if i % 50 else None, None if i % 41 == 0 else " \t".join(f"w{gen.integers(99)}" for _ in range(size)) + "\n", source, 1, "x", None))
    out += [(1000, "word " * 3000, "b", 1, "x", None), (1001, "one two", "b", 1, "x", None), (1001, "one two", "b", 1, "x", None), (1002, "", "void", 1, "x", None)]
    return out + [(2000, "five words are in here", "copies", 1, "x", None)] * 40


def test_mix(frame):
    rows = mixture(np.random.default_rng(4))
    size = lambda t: len((t or "").split())
    got = mixing.mix(frame(rows, MIXED)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=key) == sorted(((r[0], r[2], size(r[1])) for r in rows), key=key)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    want = shared(sizes)
    for s, total in sizes.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == total and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part for r in mine)
        # where repeated rows stand at the end each gives an equal part
        assert abs(sum(r.taken for r in mine) - want[s]) <= (40 if s == "copies" else 2), s
        # the dual optimum: rates are one tilt's, and meet the target
        assert abs(sum(r.rate * r.size for r in mine) - want[s]) <= 1e-6 * want[s] + 1e-6, s
        tilts = [np.log(r.rate) / r.size for r in mine if r.size and 0 < r.rate < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-9, s
        assert all(r.copies in (int(np.floor(r.rate)), int(np.floor(r.rate)) + 1) for r in mine if r.size and 0 < r.rate < 2 and not r.part) or s == "copies"
    again = mixing.mix(frame(sorted(rows, key=key, reverse=True), MIXED, 7)).collect()
    every = lambda rs: sorted(str(r) for r in rs)
    assert every(got) == every(again)


def test_mix_edges(frame):
    assert mixing.mix(frame([], MIXED, 1)).count() == 0
    only = mixing.mix(frame([(1, None, None, 1, "x", None), (2, " ", "a", 1, "x", None)], MIXED)).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0), (0, 0.0, 0)]
    one = mixing.mix(frame([(1, "a b c d", "a", 1, "x", None)], MIXED)).first()
    assert (one.target, one.taken, one.copies, one.part) == (6.0, 6, 1, 2)


def test_mixed_texts(frame):
    """The documents that come out have the words that the plan says."""
    rows = [r for r in mixture(np.random.default_rng(8)) if r[0] is not None]
    df = frame(rows, MIXED)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in plan.items() if v} == taken


def test_words(spark):
    texts = ["", " ", "a", " a\tb\n", "a\x0bb\x0cc\rd", "a\x1cb c d", "\U0001f600 x", None, "é" * 9]
    import re

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def split(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def searched(docs, items, k=50):
    from math import floor, log

    held = [(i, split(t)) for i, t in docs]
    n_docs, length = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * sum(1 for _, w in held if t in w) + 1))) for t in terms}
        scored = []
        for i, w in held:
            m = 50 + 50 * len(w) * n_docs // max(1, length)
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "matches", "k"), [(1 << 22, 1, 200), (2000, 10, 3)])
def test_lexical_search(frame, monkeypatch, block, matches, k):
    monkeypatch.setattr(lexical_search, "MATCHES", matches)
    gen = np.random.default_rng(2)
    pick = lambda n: [f"{'Wé日'[x % 3]}{x}" for x in np.minimum(gen.geometric(0.04, n), 90)]
    docs = [(i, "-".join(pick(int(gen.integers(0, 60))))) for i in range(150)]
    docs += [(150 + i, docs[3][1]) for i in range(70)]  # ties
    docs += [(300, None), (301, ""), (302, " .,;\x00"), (None, docs[4][1]), (303, "Wé " * 4000), docs[5], docs[5], (304, "KK w1 W1")]
    items = [(i, " ".join(pick(12))) for i in range(30)] + [(30, None), (31, ""), (None, "w1 w2"), (32, "nothing here"), (5, "W1, w1! w3"), (5, "W1, w1! w3"), (33, "K")]
    got = lexical_search.search(frame([(*r, "a", 1, 2) for r in docs], "doc_id long, text string, id string, n int, score int"), frame([(*r, 1) for r in items], "item_id long, text string, rank int"), k, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == searched(docs, items, k)


def test_lexical_search_edges(frame):
    docs, items = frame([(1, "a b")], "doc_id long, text string"), frame([("x", "b")], "item_id string, text string")
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == searched([(1, "a b")], [("x", "b")])
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_radix():
    keys = np.random.default_rng(1).integers(0, 2**40, 5000)
    assert (lexical_search.radix(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical_search.radix(keys[:0])) == 0


def test_impacts_of_any_length():
    """The product of a long text's terms and the number of documents may pass 64 bits."""
    got = lexical_search.impacts(np.array([10**8]), np.array([0]), np.array([0]), np.array([7]), np.array([9000]), 10**12, 10**15)
    assert got.tolist() == [9000 * (7 * 10**9 // (7000 + 20 * (50 + 50 * 10**8 * 10**12 // 10**15)))]
