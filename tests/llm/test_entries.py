"""Registered operator queries against SQL, and the pipeline against its stages' own rules."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from marginalia.llm import decontaminate, jaccard_join

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, SF).toArrow(), db.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(str([r[c] for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_near_copies_go(spark, frame, tmp_path):
    a, b = ([f"{x}{i}" for i in range(100)] for x in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(a + [f"more{i}" for i in range(20)])), (3, " ".join(b)), (4, " ".join("new" if i in (30, 60) else w for i, w in enumerate(b)))]
    frame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), "test")
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count()
        if name == "n-gram Jaccard join":
            assert jaccard_join.join(after).where("doc_id <> component_id").count() == 0
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.digest(decontaminate.find(after, bench)).where("contaminated").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
