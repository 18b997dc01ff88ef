"""Commits that stop anywhere, steps of a session, streams that are stopped and resumed."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.config import Config, preset
from marginalia.plans import inference
from marginalia.schema import MANIFEST
from marginalia.sources import commits, journal, scratch
from marginalia.streaming import resume

SCHEMA = "id string, v long"


def rows(n=12):
    return [(f"q{i:02d}", "nextqa", "val", f"v{i % 5}.mp4", "0" * 64, f"what {i}?", ["a", "b", "c"], i % 3, "TN", 0.0, None) for i in range(n)]


class Crash(Exception):
    pass


def crashing(monkeypatch, point):
    """Let a commit stop at a point."""
    log, once = commits.CommitLog, commits.create_once

    def stop(*_, **__):
        raise Crash(point)

    if point == "data half written":

        def move(self, staged, attempt):
            store, at = commits.scratch.place(self.spark, staged)
            some = [s.getPath() for s in store.listStatus(at) if s.getPath().getName().endswith(".parquet")]
            store.rename(some[0], commits.scratch.place(self.spark, f"{self.data}/{attempt}-00000.parquet")[1])
            raise Crash(point)

        monkeypatch.setattr(log, "_move", move)
    elif point == "before the move":
        monkeypatch.setattr(log, "_move", stop)
    elif point == "before the entry":
        monkeypatch.setattr(log, "_publish", stop)
    elif point == "within the entry":  # its text is written, its name not given
        monkeypatch.setattr(commits.os, "link", stop)
    else:

        def after(*args):
            once(*args)
            raise Crash(point)

        monkeypatch.setattr(commits, "create_once", after)


@pytest.mark.parametrize("point", ["before the move", "data half written", "before the entry", "within the entry", "after the entry"])
def test_a_commit_is_whole_or_not_there(spark, tmp_path, monkeypatch, point):
    book = journal.Journal(spark, str(tmp_path / "run"), spark.createDataFrame([], SCHEMA).schema)
    batch = lambda a, b: spark.createDataFrame([(f"q{i}", i) for i in range(a, b)], SCHEMA).repartition(3)
    assert book.put(batch(0, 5), "one", new=True)
    with monkeypatch.context() as m:
        crashing(m, point)
        with pytest.raises(Crash):
            book.put(batch(5, 9), "two", new=True)
    found = {r.id for r in book.results().collect()}
    assert found == {f"q{i}" for i in range(9 if point == "after the entry" else 5)}
    assert book.put(batch(5, 9), "two", new=True) == (point != "after the entry")
    assert not book.put(batch(5, 9), "two", new=True)
    book.put(batch(3, 11))
    again = journal.Journal(spark, str(tmp_path / "run"), book.schema)
    assert sorted(r.v for r in again.results().collect()) == list(range(11))


def test_two_writers_of_one_batch(spark, tmp_path):
    """Of two that write a batch at a time the first one's entry holds."""
    log = commits.CommitLog(spark, str(tmp_path / "data"), str(tmp_path / "log"))
    log.begin()
    df = spark.createDataFrame([("a", 1)], SCHEMA)
    df.write.parquet(str(tmp_path / "data/_staged/x"))
    names = log._move(str(tmp_path / "data/_staged/x"), "x")
    assert log.commit("one", df)
    assert not log._publish("one", names)
    assert log.read(df.schema).count() == 1
    with pytest.raises(ValueError, match="name"):
        log.commit("../one", df)


def test_journal_without_a_log(spark, tmp_path):
    """Files of a journal from before there were logs are read, and kept when it goes on."""
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).write.parquet(str(tmp_path / "results"))
    book = journal.Journal(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    assert book.results().count() == 2
    book.put(spark.createDataFrame([("b", 2), ("c", 3)], SCHEMA))
    assert sorted(r.id for r in book.results().collect()) == ["a", "b", "c"]


@pytest.fixture
def manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    spark.createDataFrame(rows(), MANIFEST).write.option("ignoreNullFields", "false").json(path)
    return path


def test_pending_is_found_once(spark, manifest, tmp_path, monkeypatch):
    """Many steps look for pending rows once, read only their own, and come in order of video, start and id."""
    looked, given = [], []
    monkeypatch.setattr(resume, "pending", lambda *a, **k: looked.append(1) or _pending(*a, **k))

    def infer(df, config):
        if df.limit(1).count():
            given.append([r.id for r in df.select("id").collect()])
        return inference.results(df, config)

    infer_ = lambda df, config: infer(df, config)
    assert resume.run(spark, preset("mock"), manifest, str(tmp_path / "run"), max_new=5, step=2, infer=infer_) == resume.PARTIAL
    assert resume.run(spark, preset("mock"), manifest, str(tmp_path / "run"), resume=True, step=3, infer=infer_) == resume.COMPLETE
    assert len(looked) == 2 and [len(g) for g in given] == [2, 2, 1, 3, 3, 1]
    want = [r[0] for r in sorted(rows(), key=lambda r: (r[3], r[9], r[0]))]
    assert [i for g in given for i in sorted(g, key=want.index)] == want
    entries = [json.loads(p.read_text()) for p in (tmp_path / "run/commits").glob("*.json") if p.name != "begin.json"]
    assert len(entries) == 6 and all(entries)


_pending = resume.pending


def test_few_steps_are_read_by_many_tasks(spark, tmp_path):
    """A step's rows lie in several files, so that more than one task reads and answers them; none is left out."""
    done, table = spark.createDataFrame([], "id string"), spark.createDataFrame(rows(400), MANIFEST)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions that are not small
    try:
        count, todo = resume.steps(table, done, 200, 0, str(tmp_path / "pending"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {k: {p.name for p in (tmp_path / f"pending/steps/step={k}").glob("*.parquet")} for k in (0, 1)}
    assert count == 400 and all(len(names) > 1 for names in files.values())
    assert [r["count"] for r in todo.groupBy("step").count().orderBy("step").collect()] == [200, 200]
    count, todo = resume.steps(table, done, 10, 25, str(tmp_path / "many"))  # three steps, the last of them half
    assert [r["count"] for r in todo.groupBy("step").count().orderBy("step").collect()] == [10, 10, 5]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """A stop between batches leaves whole batches; the events tell of start, batches, stop and error."""
    df = spark.createDataFrame(rows(), MANIFEST)
    for k in range(4):
        df.where(F.substring("id", 2, 2).cast("int") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    config = Config(backend="mock", method="evidence", margin_threshold=1.0, limit=0)
    book = journal.Journal(spark, str(tmp_path / "run"), inference.results(df, config).schema)
    stop, batches = [], []

    def infer(part, config):
        batches.append(1)
        if len(batches) == 2:
            stop.append(15)
        return inference.results(part, config)

    run = lambda **more: resume.run_stream(source(), config, book, str(tmp_path / "checkpoint"), **more)
    assert run(infer=infer, stop=stop) == resume.PARTIAL
    assert book.results().count() == 6 and len(batches) == 2

    def broken(part, config):
        raise ArithmeticError("no model")

    with pytest.raises(Exception, match="no model"):
        run(infer=broken)
    assert book.results().count() == 6
    assert run() == resume.COMPLETE
    whole = {r.id: r for r in inference.results(df, config).collect()}
    assert {r.id: r for r in book.results().collect()} == whole and book.results().count() == 12
    events = [(r.event, json.loads(r.detail)) for r in spark.read.json(book.events_path).collect()]
    kinds = sorted(e for e, _ in events)
    assert kinds.count("session_start") == 3 and kinds.count("batch") == 4 and kinds.count("error") == 1
    assert sorted(d["stopped"] for e, d in events if e == "session_end") == [False, True]
    assert sum(d["rows"] for e, d in events if e == "batch") == 12


def test_run_with_a_named_model(spark, tmp_path):
    """The command line's way: a model by name, frames from a table, two sessions, measured rows."""
    import random

    from marginalia import cli
    from marginalia.plans import phases

    gen = random.Random(5)
    made = [(f"q{i:02d}", "nextqa", "val", f"v{i % 3}.mp4", "0" * 64, "what " * (1 + i % 5), ["a", "b", "c"], i % 3, "TN", float(i % 2), None if i % 4 else 9.0) for i in range(12)]
    spark.createDataFrame(made, MANIFEST).write.option("ignoreNullFields", "false").json(str(tmp_path / "manifest"))
    frames = spark.createDataFrame([(f"v{v}.mp4", t / 4, [gen.gauss(0, 0.05) for _ in range(64)]) for v in range(3) for t in range(50)], "video string, t double, frame array<float>")
    config = Config(backend="mock", method="evidence", frames=8, initial_frames=4, candidate_frames=16, limit=0)
    infer = phases.runner(cli.loader("marginalia.plans.linear:LinearModel"), frames)
    run = lambda **more: resume.run(spark, config, str(tmp_path / "manifest"), str(tmp_path / "run"), infer=infer, step=4, **more)
    assert run(max_new=4) == resume.PARTIAL
    assert run(resume=True) == resume.COMPLETE
    _, found = journal.read_run(spark, str(tmp_path / "run"), infer(spark.createDataFrame([], MANIFEST), config).schema)
    got = {r.id: r for r in found.collect()}
    assert len(got) == 12 and all(r.elapsed_seconds > 0 and r.peak_vram_allocated_gib > 0 and r.execution.node and r.execution.resolved_dtype == "float64" for r in got.values())
    summary = json.loads((tmp_path / "run/summary.json").read_text())
    assert summary["complete"] and summary["peak_vram_allocated_gib"] > 0 and summary["resolved_dtype"] == "float32"
    for r in got.values():
        start, end = float(int(r.id[1:]) % 2), 9.0 if int(r.id[1:]) % 4 == 0 else 13.25
        times = [t / 4 for t in range(50) if start <= t / 4 < end]
        middles = [start + (i + 0.5) * (end - start) / 16 for i in range(16)]
        want = sorted({next(t for t in times if t >= m) for m in middles if any(t >= m for t in times)})
        assert r.candidate_frames == len(want) and set(r.calls[0].timestamps) <= set(want)
    with pytest.raises(ValueError, match="module:Class"):
        cli.loader("marginalia")
    with pytest.raises(Exception, match="no frames for"):
        phases.pool(spark.createDataFrame(made, MANIFEST), frames.where("video <> 'v1.mp4'"), 16)[0].select("times").collect()


def test_a_session_leaves_no_scratch(spark, manifest, tmp_path, monkeypatch):
    """A session's pending rows go with it, and so do shuffle files of what it writes; the setting for that does not stay."""
    config, key = Config(backend="mock", method="uniform", limit=0), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    paths, fresh, within, before = [], scratch.fresh, [], spark.conf.get(key, None)
    monkeypatch.setattr(scratch, "fresh", lambda spark, name: paths.append(fresh(spark, name)) or paths[-1])
    infer = lambda df, config: within.append(spark.conf.get(key, None)) or inference.results(df, config)
    assert resume.run(spark, config, manifest, str(tmp_path / "run"), step=5, infer=infer) == resume.COMPLETE
    assert paths and not any(scratch.exists(spark, p) for p in paths)
    assert within[1:] == ["true"] * 3 and spark.conf.get(key, None) == before
