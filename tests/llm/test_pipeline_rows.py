"""Stages of the pipeline over odd rows, and the removal of shared passages."""

import random

import pytest

import corpus_pipeline
from marginalia.llm import substring_dedup as S

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, spans string, id string"


def odd_rows():
    prose = " ".join(f"plain{i % 37} words{i % 11} of{i % 5} prose" for i in range(200))
    rows = [(1, None), (None, prose + " alpha"), (2, ""), (3, " \n\t "), (4, prose), (4, prose), (5, "é日本 \x00\x1c " * 40), (6, "long " * 60_000), (7, "unique text about rivers and hills and their names " * 3)]
    return [(i, t, "en", "s", None, 9, 0.5, "x", "y") for i, t in rows]


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_odd_rows(spark, frame, name):
    df = frame(odd_rows(), COLUMNS)
    got = STAGES[name](spark, df, SF)
    assert got.schema == df.schema
    rows = sorted((str(r.doc_id), r.text is None, r.text or "") for r in got.collect())
    whole = sorted((str(r[0]), r[1] is None, r[1] or "") for r in odd_rows())
    assert set(rows) <= set(whole)
    if name == "n-gram Jaccard join":
        assert [r for r in rows if r[0] in ("1", "2", "3", "5", "6", "7")] == [r for r in whole if r[0] in ("1", "2", "3", "5", "6", "7")]
        assert len([r for r in rows if "plain0" in r[2]]) == 1
    elif name != "quality classifier":
        assert rows == whole
    assert STAGES[name](spark, df.limit(0), SF).count() == 0


def test_odd_rows_are_packed(spark, frame):
    df = frame(odd_rows(), COLUMNS)
    got = STAGES["packing"](spark, df, SF).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, 0)
        whole[r.doc_id] += r.length
    assert set(whole) == {1, None, 2, 3, 4, 5, 6, 7} and whole[1] == whole[2] == whole[3] == 1
    assert whole[4] == 2 * next(r.doc_tokens for r in got if r.doc_id == 4)
    assert STAGES["packing"](spark, df.limit(0), SF).count() == 0


def test_shared_passages_are_removed(frame):
    """Each planted passage, whole copies and repeats in a text among them, stands once afterwards; all else stays."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    rows, passages, own = [], [], []
    for _ in range(15):
        passage = words(rng.randint(60, 120))
        passages.append(" ".join(passage))
        for _ in range(rng.randint(2, 5)):
            a, b = words(30), words(25)
            own += [" ".join(a), " ".join(b)]
            rows.append((len(rows), f"{' '.join(a)}, {passages[-1]}! {' '.join(b)}"))
    twice, whole = " ".join(words(70)), " ".join(words(90))
    rows += [(100, f"{twice} here {' '.join(words(50))} {twice}"), (101, whole), (102, whole), (102, whole), (None, whole), (103, None), (104, ""), (105, "few words")]
    df = frame([(*r, "c", 1) for r in rows], "doc_id long, text string, cuts string, row int")
    out = S.remove(df)
    assert out.schema == df.schema
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    text = "\n".join(r.text or "" for r in got)
    for passage in [*passages, twice, whole]:
        assert text.count(passage) == 1
    assert all(x in text for x in own) and "few words" in text
    assert [r.text for r in got if r.doc_id == 103] == [None]
    assert S.remove(df.limit(0)).count() == 0
