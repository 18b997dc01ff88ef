"""Groups against all pairs of shingle sets."""

import numpy as np
import pytest

from marginalia.llm import graph
from marginalia.llm import jaccard_join as J


def brute(rows, k=4, t=(85, 100)):
    sets = []
    for _, x in rows:
        w = J.words(x or "")
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and t[1] * len(sets[a] & sets[b]) >= t[0] * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        r = find(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((rows[a][0], len(sets[a]), least[find(a)] if sets[a] else rows[a][0]) for a in range(len(rows))), key=str)


def near(rng, vocabulary, text, n):
    w = text.split()
    for _ in range(n):
        j, r = rng.randrange(len(w)), rng.random()
        if r < 0.5:
            w[j] = rng.choice(vocabulary)
        elif r < 0.75 and len(w) > 5:
            del w[j]
        else:
            w.insert(j, rng.choice(vocabulary))
    return " ".join(w)


@pytest.fixture
def rows(rng, vocabulary):
    out = []
    for _ in range(60):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 10, 12, 20, 40, 80, 150, 400])))
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            out.append((len(out) + 100, near(rng, vocabulary, base, rng.choice([0, 0, 1, 1, 2, 3, 5]))))
    big = " ".join(rng.choices(vocabulary, k=300))
    out += [(len(out) + 100 + i, near(rng, vocabulary, big, rng.randint(0, 9))) for i in range(50)]
    out += [(None, None), (5, ""), (6, "  \n"), (7, "a b"), (8, "A b"), (None, "a b"), (7, "q r s t u"), (None, "zz yy xx ww vv uu")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [J.CHUNK_CLASSES, 7])
def test_groups(frame, rows, chunk):
    got = J.similar(frame(rows, "doc_id long, text string"), chunk_classes=chunk).collect()
    assert sorted(((r["id"], r["n"], r["component"]) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize(("k", "t"), [(4, (85, 100)), (5, (80, 100))])
def test_similar_sets_share_a_part(rng, k, t):
    """Whatever shingles count as common, and for every cut."""
    shared = 0
    for _ in range(4000):
        n = rng.choice([2, 3, 6, 7, 9, 12, 20, 50, 200])
        s = [rng.getrandbits(64) for _ in range(n)]
        gone = rng.randint(0, int(n * 0.25))
        r = s[gone:] + [rng.getrandbits(64) for _ in range(rng.randint(0, int(n * 0.25)))]
        if set(s) != set(r) and t[1] * len(set(s) & set(r)) >= t[0] * len(set(s) | set(r)):
            common = np.sort(np.array(rng.sample(s, n // 2) + [rng.getrandbits(64) for _ in range(3)], np.uint64))
            a, b = (np.sort(np.array(x, np.uint64)) for x in (s, r))
            for seed, known in ((0, common[:0]), (0, common), (1, common), (2, common[:0])):
                assert np.intersect1d(J.part_signatures(a, t, seed, known), J.part_signatures(b, t, seed, known)).size
            shared += 1
    assert shared > 300


def test_large_blocks_are_cut_again(frame, rng, vocabulary):
    """Texts with a long common line, of which only some are alike, in blocks of at most four classes."""
    line = rng.choices(vocabulary, k=25)
    rows = []
    for _ in range(40):
        own = rng.choices(vocabulary, k=30)
        rows += [(len(rows) + i, " ".join(line + own[:i] + own[i + 1 :])) for i in range(rng.choice([1, 2]))]
    got = J.similar(frame(rows, "doc_id long, text string"), size=5, threshold=(80, 100), chunk_classes=4).collect()
    assert sorted(((r["id"], r["n"], r["component"]) for r in got), key=str) == brute(rows, 5, (80, 100))


def test_keep_one(frame, rows):
    df = frame([(i, x, "c", j, j) for j, (i, x) in enumerate(rows)], "doc_id long, text string, part string, _row int, ROW int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert all((r.doc_id, r.text) == rows[r._row] and r._row == r.ROW for r in kept.collect())
    groups = {c for i, n, c in brute(rows) if n}
    assert {r.doc_id for r in kept.collect() if J.words(r.text or "")} == groups
    assert kept.where("text is null or trim(text) in ('', '\n')").count() == 3


def test_empty_and_odd(frame, odd_docs):
    assert J.join(frame([], "doc_id long, text string", 1)).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.join(odd_docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 3, 5)} <= got
    assert J.join(odd_docs).count() == 8


def test_edges_leave_in_forests(rng):
    edges = np.array([(rng.randrange(3000), rng.randrange(3000)) for _ in range(6000)])
    for held in (10, 700, 10**6):
        reduced, out = graph.Edges(held), []
        for part in np.array_split(edges, 50):
            out += reduced.add(*part.T)
        out += reduced.rest()
        nodes, least = graph.forest(*edges.T)
        again = graph.forest(*(np.concatenate(x) for x in zip(*out, strict=True)))
        assert (again[0] == nodes).all() and (again[1] == least).all()


def test_components(spark, rng):
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)]
    nodes, least = graph.forest(*np.array(edges).T)
    want = dict(zip(nodes.tolist(), least.tolist(), strict=True))
    for one_task in (0, 10**6):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), one_task=one_task).collect()}
        assert all(got[x] == want.get(x, x) for x in got) and set(want) <= set(got)


def test_texts_are_not_moved(spark, frame, rows, monkeypatch):
    """With more classes and rows than are broadcast at once, texts meet them part by part, and no join sorts texts."""
    from marginalia.llm import jaccard_join as J

    docs = frame(rows, "doc_id long, text string")
    want = sorted(J.keep_one(docs).select("doc_id", "text").collect(), key=str)
    plans, written = [], J.written
    noted = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name)
    monkeypatch.setattr(J, "written", noted)
    monkeypatch.setattr(J, "BROADCAST_IDS", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = J.keep_one(docs, "doc_id", "text")
        plans.append(kept._jdf.queryExecution().executedPlan().toString())
        assert sorted(kept.select("doc_id", "text").collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with_texts = [p for p in plans if "text#" in p]
    assert with_texts and not any("SortMergeJoin" in p for p in with_texts)


def test_forests_are_joined_before_rounds(spark, rng, monkeypatch):
    """Edges that many tasks hold alike are reduced to one forest before any round over the cluster."""
    from marginalia.llm import graph

    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(2000)]
    names, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or written(df, name))
    df = spark.createDataFrame(edges * 4, "a long, b long").repartition(8)
    got = {r.node: r.component for r in graph.components(df, one_task=1000).collect()}
    assert "edges" not in names
    assert all(got[a] == got[b] for a, b in edges if a != b) and len(set(got.values())) <= 5


def test_signatures_of_one_half_are_told_apart():
    """Signatures of a bucket whose lower 32 bits are the same don't meet."""
    sig = np.array([5, 5 + (1 << 35), 5, (1 << 39) + 7], np.uint64)
    short = sig.view(np.uint8).reshape(-1, 8)[:, : J.SHORT].tobytes()
    assert J._whole(short).tolist() == sig.tolist()
    assert J._hubs(J._whole(short), np.array([10, 20, 30, 40]))[2].T.tolist() == [[30, 10]]


def test_sets_of_large_blocks_are_not_kept(frame, rng, vocabulary, monkeypatch):
    """However many classes a large block has, no file of their sets is written."""
    line = rng.choices(vocabulary, k=25)
    rows = [(i, " ".join(line + rng.choices(vocabulary, k=25))) for i in range(30)]
    columns, written = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: columns.append((name, df.columns)) or written(df, name))
    got = J.similar(frame(rows, "doc_id long, text string"), size=5, threshold=(80, 100), chunk_classes=4).collect()
    assert sorted(((r["id"], r["n"], r["component"]) for r in got), key=str) == brute(rows, 5, (80, 100))
    assert "sampled" in [name for name, _ in columns] and not [name for name, c in columns if "x" in c]


def test_written_frees_its_shuffle(spark):
    """Shuffle files go when the table is written, not when the driver collects garbage."""
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}
    before = {x for x in data() if x.startswith("shuffle_")}
    assert J.written(spark.range(1000).repartition(4, "id"), "shuffled").count() == 1000
    left = lambda: {x for x in data() if x.startswith("shuffle_")} - before
    end = time.monotonic() + 10
    shuffles = lambda: {x.split("_")[1] for x in left()}
    while len(shuffles()) > 1 and time.monotonic() < end:  # that of the count stays
        time.sleep(0.1)
    assert len(shuffles()) <= 1
