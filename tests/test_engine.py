"""Adapters, rules, runs, resume, comparison."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia import cli
from marginalia.config import Config, preset
from marginalia.functions import selectors, text
from marginalia.operators import compare, frames, metrics, rules, subset
from marginalia.plans import inference
from marginalia.schema import MANIFEST
from marginalia.sources import annotations, journal
from marginalia.sources import manifest as manifests
from marginalia.streaming import resume


def rows(n=12):
    return [(f"q{i}", "nextqa", "val", f"v{i // 2}.mp4", "0" * 64, f"what {i}?", ["a", "b", "c", "d", "e"], i % 5, "TN", 0.0, None) for i in range(n)]


@pytest.fixture
def manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    spark.createDataFrame(rows(), MANIFEST).write.option("ignoreNullFields", "false").json(path)
    return path


def test_nested_adapter(spark, tmp_path):
    record = {"question_id": "Interaction_T1_1", "video_id": "v", "start": 1.2, "end": 3.4, "question": "q?", "answer": " yes", "choices": [{"choice_id": 1, "choice": "no"}, {"choice_id": 0, "choice": "yes"}], "situations": {"leak": 1}}
    (tmp_path / "a.json").write_text(json.dumps([record]))
    row = annotations.nested(annotations.read_nested(spark, str(tmp_path / "a.json")), "val").first()
    assert (row.id, row.choices, row.answer, row.question_type, row.start, row.end) == ("star:val:Interaction_T1_1", ["yes", "no"], 0, "Interaction", 1.2, 3.4)


def test_prepare_flat(spark, tmp_path):
    (tmp_path / "videos/x").mkdir(parents=True)
    (tmp_path / "videos/x/clip.MP4").write_bytes(b"abc")
    (tmp_path / "a.csv").write_text('\ufeffvideo,qid,question,answer,type,a0,a1,a2,a3,a4\n7,1,"a ""b"" c?",2,TN,p,q,r,s,t\n7,2,open?,,TN,p,q,r,s,t\n')
    (tmp_path / "map.json").write_text('{"7": "x/clip"}')
    out = str(tmp_path / "m")
    assert annotations.prepare(spark, "nextqa", str(tmp_path / "a.csv"), str(tmp_path / "videos"), "val", out, str(tmp_path / "map.json")) == 2
    got = {r.id: r for r in manifests.read(spark, out).collect()}
    assert got["nextqa:val:7:1"].video == "x/clip.MP4"
    assert got["nextqa:val:7:1"].question == 'a "b" c?'
    assert got["nextqa:val:7:2"].answer is None
    with pytest.raises(Exception, match="(?i)exists"):
        annotations.prepare(spark, "nextqa", str(tmp_path / "a.csv"), str(tmp_path / "videos"), "val", out, str(tmp_path / "map.json"))
    (tmp_path / "map.json").write_text("{}")
    with pytest.raises(ValueError, match="no video"):
        annotations.prepare(spark, "nextqa", str(tmp_path / "a.csv"), str(tmp_path / "videos"), "val", out + "2", str(tmp_path / "map.json"))


@pytest.mark.parametrize(("change", "rule"), [({"video": "../v.mp4"}, "video_path"), ({"id": ""}, "id_split"), ({"question": "\u00a0 "}, "question"), ({"choices": ["a"]}, "choices"), ({"choices": ["a", None]}, "choices"), ({"answer": 5}, "answer"), ({"start": -1.0}, "start"), ({"end": 0.0}, "end"), ({"video_sha256": "F" * 64}, "sha256")])
def test_rules(spark, change, rule):
    row = dict(zip(MANIFEST.names, rows(1)[0], strict=True)) | change
    schema = MANIFEST.fromJson(json.loads(MANIFEST.json()))
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert {r.rule for r in rules.violations(df).where("violations > 0").collect()} == {rule}
    with pytest.raises(ValueError, match=rule):
        rules.require(df)


def test_repeated_ids(spark):
    with pytest.raises(ValueError, match="repeated ids: q0"):
        rules.require(spark.createDataFrame(rows(2) + rows(1), MANIFEST))


def test_paths(spark):
    df = spark.createDataFrame([("a/b.mp4",), ("/a",), ("a/../b",), ("c:\\x",), ("",), ("a..b/c",), (None,)], "p string")
    assert [r.ok for r in df.select(text.safe_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, False, True, False]


def test_subset_order_free(spark):
    df = spark.createDataFrame(rows(), MANIFEST)
    pick = lambda x: [r.id for r in subset.subset(x, 5, 18).collect()]
    assert pick(df) == pick(df.orderBy(F.desc("id")))
    assert len(subset.subset(df, 0, 18).collect()) == 12


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)] + [(None,)], "v double")
    assert metrics.percentiles(df, "v", {"p50": 0.5, "p0": 0.0, "p1": 1.0}).first().asDict() == {"p50": 3.0, "p0": 1.0, "p1": 4.0}
    assert metrics.nearest_rank(df, "v", {"p50": 0.5}).first().p50 == 3.0
    assert metrics.percentiles(df.limit(0), "v", {"p50": 0.5}).first().p50 is None


def test_candidate_pool(spark):
    times = [i / 10 for i in range(40)]
    got = frames.candidate_pool(spark.createDataFrame([(1, t) for t in times], "clip long, t double"), spark.createDataFrame([(1, 1.05, 2.25)], "clip long, start double, end double"), 8)
    want = []
    for i in range(8):
        after = [t for t in times if 1.05 <= t < 2.25 and t >= 1.05 + (i + 0.5) * 1.2 / 8]
        want += after[:1]
    assert sorted(r.t for r in got.collect()) == sorted(set(want))


class Fixed:
    def __init__(self, *scores):
        self.values = scores

    def scores(self, id, question, choices, ids, timestamps):
        return F.array(*[F.lit(x) for x in self.values])

    def tokens(self, ids):
        return (F.size(ids) * 10).cast("int")


@pytest.mark.parametrize(("method", "queries"), [("evidence", 3), ("uniform_refine", 0)])
def test_gate(spark, method, queries):
    df = spark.createDataFrame([("q", "what?", ["yes", "no"], 0.0)], "id string, question string, choices array<string>, start double")
    config = Config(backend="mock", method=method)
    sure = inference.infer(inference.with_mock_pool(df, 64), config, Fixed(0.9, 0.1)).first()
    unsure = inference.infer(inference.with_mock_pool(df, 64), config, Fixed(0.51, 0.49)).first()
    assert (len(sure.calls), sure.refined, sure.selector_queries) == (1, False, 0)
    assert (len(unsure.calls), unsure.refined, unsure.selector_queries, unsure.frame_presentations, unsure.final_frames) == (2, True, queries, 24, 16)
    with pytest.raises(Exception, match="probability"):
        inference.infer(inference.with_mock_pool(df, 64), config, Fixed(float("nan"), 0.4)).collect()


def test_resume_equals_whole(spark, manifest, tmp_path):
    config, whole, parts = preset("mock"), str(tmp_path / "whole"), str(tmp_path / "parts")
    assert resume.run(spark, config, manifest, whole) == resume.COMPLETE
    assert resume.run(spark, config, manifest, parts, max_new=5) == resume.PARTIAL
    with pytest.raises(FileExistsError):
        resume.run(spark, config, manifest, parts)
    with pytest.raises(ValueError, match="contract"):
        resume.run(spark, Config(backend="mock", method="uniform", limit=0), manifest, parts, resume=True)
    assert resume.run(spark, config, manifest, parts, resume=True, step=3) == resume.COMPLETE
    assert resume.run(spark, config, manifest, parts, resume=True) == resume.COMPLETE
    read = lambda folder: [r.asDict(True) for r in spark.read.parquet(f"{folder}/results").orderBy("id").collect()]
    assert read(whole) == read(parts) and len(read(parts)) == 12
    found = cli.compare(spark, whole, parts, 50)
    assert (found["delta_accuracy_right_minus_left"], found["video_cluster_bootstrap_95_ci"], found["videos"]) == (0.0, [0.0, 0.0], 6)
    assert json.loads((tmp_path / "parts/summary.json").read_text())["complete"]


def test_lock(tmp_path):
    with journal.lock(tmp_path), pytest.raises(RuntimeError, match="writer"), journal.lock(tmp_path):
        pass


def test_seeded_interval(spark):
    df = spark.createDataFrame([("d", f"v{i}", i % 3 - 1, 2, f"id{i}") for i in range(8)], "dataset string, video string, diff long, n long, first_id string")
    low, high = compare.seeded_interval(df, 200)
    assert (low, high) == compare.seeded_interval(df.orderBy(F.desc("video")), 200)
    assert -0.5 <= low <= high <= 0.5


@pytest.mark.parametrize("broken", [{"method": "none"}, {"frames": 0}, {"frames": 4}, {"margin_threshold": 2.0}, {"neighbor_seconds": 0.0}, {"relevance_weight": float("nan")}, {"limit": -1}, {"revision": "main"}, {"dtype": "int8"}])
def test_config(broken):
    with pytest.raises(ValueError):
        Config(**broken)


def test_demo(spark, tmp_path):
    summary = cli.demo(spark, str(tmp_path / "demo"))
    assert summary["completed_count"] == 10 and {k: v["n"] for k, v in summary["per_type"].items()} == {"Sequence": 5, "Prediction": 5}


def test_scores_are_checked(spark):
    """Of the evidence selector's three rows each must have a finite score for every frame; an input over the token cap is refused."""
    df = inference.with_mock_pool(spark.createDataFrame([("q", "what?", ["yes", "no"], 0.0)], "id string, question string, choices array<string>, start double"), 64)

    class Scores:
        def __init__(self, broken):
            self.broken = broken

        def relevance(self, text, times):
            return F.when(F.element_at(F.split(text, " "), -1) == self.broken, F.array(F.lit(float("nan")))).otherwise(F.transform(times, lambda x: x))

    config = Config(backend="mock", method="evidence", margin_threshold=1.0)
    assert inference.infer(df, config, Fixed(0.51, 0.49), Scores("nothing")).first().refined
    for broken in ("what?", "yes", "no"):
        with pytest.raises(Exception, match="must be finite"):
            inference.infer(df, config, Fixed(0.51, 0.49), Scores(broken)).collect()
    with pytest.raises(Exception, match="more than 100 tokens"):
        inference.infer(df, Config(backend="mock", method="uniform", max_input_tokens=100), Fixed(0.9, 0.1)).collect()


def test_other_splitter(spark):
    halves = lambda scores, levels: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(1).alias("depth")) for a, b in ((0, 4), (4, 8))])
    df = spark.createDataFrame([([9.0, 8.0, 7.0, 6.0, 1.0, 2.0, 3.0, 4.0],)], "s array<double>")
    assert df.select(selectors.segment_quota(F.col("s"), 4, depth=3, splitter=halves)["ids"].alias("ids")).first().ids == [0, 1, 6, 7]


def test_percentiles_of_many_values(spark):
    """Above the size where all values are ranked, per group and over all."""
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(7919)).cast("double").alias("v"))
    values = sorted((r.g, r.v) for r in df.collect())
    fractions = {"a": 0.025, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}
    at = lambda xs: {k: xs[round((len(xs) - 1) * f)] for k, f in fractions.items()}
    assert metrics.percentiles(df, "v", fractions).first().asDict() == at(sorted(v for _, v in values))
    for row in metrics.nearest_rank(df, "v", fractions, "g").collect():
        assert row.asDict() == {"g": row.g} | at([v for g, v in values if g == row.g])
