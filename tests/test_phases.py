"""Two-phase inference with models in Arrow functions, and score matrices in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.config import Config
from marginalia.operators import score_matrix
from marginalia.plans import inference, phases
from marginalia.plans.linear import LinearModel


@pytest.fixture
def clips(frame):
    """Clips of 20 and 3 frames, of which one is asked about by nearly all rows."""
    gen = np.random.default_rng(1)
    frames = frame([(c, i, [float(x) / 20 for x in gen.normal(size=64)]) for c, n in (("hot", 20), ("short", 3)) for i in range(n)], "clip string, idx int, frame array<float>")
    rows = [(f"q{i}", "short" if i % 9 == 0 else "hot", "what " * (i % 7), ["yes", "no", "maybe"][: 2 + i % 2], [0.25 * j for j in range(3 if i % 9 == 0 else 20)]) for i in range(60)]
    return frames, frame(rows, "id string, clip string, question string, choices array<string>, times array<double>")


def counting(folder):
    class Counting(LinearModel):
        def __init__(self):
            super().__init__()
            with open(f"{folder}/loads", "a") as out:
                out.write("x\n")

        def answer(self, asked):
            with open(f"{folder}/calls", "a") as out:
                out.write("".join(f"{a.id} {len(a.frames)}\n" for a in asked))
            with open(f"{folder}/batches", "a") as out:
                out.write(f"{len(asked)} {sum(a.frames.nbytes for a in asked)}\n")
            return super().answer(asked)

    return Counting


@pytest.mark.parametrize(("method", "sent"), [("evidence", 0), ("evidence", 1 << 20), ("uniform_refine", 0), ("uniform", 1 << 20), ("clip_topk", 0), ("clip_topk", 1 << 20), ("aks", 1 << 20)])
def test_second_calls_only_where_uncertain(clips, tmp_path, method, sent):
    frames, rows = clips
    config = Config(backend="mock", method=method, frames=8, initial_frames=4, candidate_frames=20)
    got = phases.infer(rows, config, phases.ArrowModels(counting(tmp_path), frames, batch_bytes=4000, per_part=7, broadcast_bytes=sent)).collect()
    calls = [x.split() for x in (tmp_path / "calls").read_text().splitlines()]
    assert len(got) == 60 and len({r.id for r in got}) == 60
    assert len(calls) == 60 + sum(r.refined for r in got)
    assert sorted(i for i, n in calls) == sorted([r.id for r in got] + [r.id for r in got if r.refined])
    if method in ("evidence", "uniform_refine"):
        assert 0 < sum(r.refined for r in got) < 60
        assert {i for i, n in calls if n == "8"} == {r.id for r in got if r.refined}
    assert all(int(b) <= 4000 or n == "1" for n, b in (x.split() for x in (tmp_path / "batches").read_text().splitlines()))
    assert len((tmp_path / "loads").read_text().splitlines()) <= 8
    assert all(len(r.calls) == 1 + r.refined and abs(sum(r.scores) - 1) < 1e-9 for r in got)


def test_equal_to_one_plan(spark, clips):
    """With column models the phases give what the one plan gives."""
    _, rows = clips
    for method in ("evidence", "uniform_refine", "uniform"):
        config = Config(backend="mock", method=method, frames=8, initial_frames=4, candidate_frames=20, margin_threshold=0.2)
        one, two = (sorted(map(str, x.collect())) for x in (inference.infer(rows, config), phases.infer(rows, config, inference.ColumnModels())))
        assert one == two


def test_frames_sent_or_joined(clips):
    """Small tables of frames are sent to the workers, large ones joined: with the same result."""
    frames, rows = clips
    config = Config(backend="mock", method="evidence", frames=8, initial_frames=4, candidate_frames=20)
    found = [phases.infer(rows, config, phases.ArrowModels(LinearModel, frames, broadcast_bytes=n)).drop("call1_cost", "call2_cost").orderBy("id").collect() for n in (0, 1 << 20)]
    assert [(r.id, r.prediction, r.refined, r.calls[-1].frame_indices) for r in found[0]] == [(r.id, r.prediction, r.refined, r.calls[-1].frame_indices) for r in found[1]]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_frames_and_answers_are_checked(clips, sent):
    frames, rows = clips
    config = Config(backend="mock", method="uniform", frames=8, initial_frames=4, candidate_frames=20)

    class Broken(LinearModel):
        def answer(self, asked):
            return [([float("nan")] * len(a.choices), n) for a, (_, n) in zip(asked, super().answer(asked), strict=True)]

    for models, message in ((phases.ArrowModels(Broken, frames), "probability"), (phases.ArrowModels(LinearModel, frames.where("idx < 19"), broadcast_bytes=sent), "missing")):
        with pytest.raises(Exception, match=message):
            phases.infer(rows, config, models).collect()
    with pytest.raises(Exception, match="more than 150 tokens"):
        phases.infer(rows, Config(backend="mock", method="uniform", max_input_tokens=150), phases.ArrowModels(LinearModel, frames)).collect()
    short = Config(backend="mock", method="clip_topk", frames=8, initial_frames=4, candidate_frames=20)
    with pytest.raises(Exception, match="must be finite"):
        phases.infer(rows, short, phases.ArrowModels(LinearModel, frames.where("idx < 19"), broadcast_bytes=sent)).collect()
    assert phases.infer(rows.limit(0), config, phases.ArrowModels(LinearModel, frames)).count() == 0


def vectors(gen, n, groups, frame):
    rows = [(str(gen.choice(groups)), i, [float(x) for x in gen.normal(size=5)]) for i in range(n)]
    rows += [("a", n, None), ("a", n + 1, [0.0] * 5), ("a", n + 2, [float("nan")] + [1.0] * 4), (None, n + 3, [1.0] * 5), ("a", n + 4, [])]
    return rows, frame(rows, "group string, key long, vector array<float>")


@pytest.mark.parametrize(("held", "streamed"), [(4096, 1 << 16), (3, 4), (1, 1000)])
def test_score_matrix(frame, held, streamed):
    gen = np.random.default_rng(2)
    left, a = vectors(gen, 50, ["a", "a", "a", "b"], frame)
    right, b = vectors(gen, 70, ["a", "a", "c", "b"], frame)
    fit = lambda rows: [(g, k, np.array(v, np.float32).astype(float)) for g, k, v in rows if g and v and np.isfinite(v).all() and any(v)]
    cosine = lambda x, y: float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y))
    want, whole = [], {}
    for g, k, v in fit(left):
        scored = [(-round(cosine(v, w), 6), j) for h, j, w in fit(right) if h == g]
        want += [(g, k, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:4])]
        if scored:
            whole[k] = [round(-s, 6) for s, j in sorted(scored, key=lambda x: x[1])]
    got = score_matrix.top(a, b, 4, digits=6, held=held, streamed=streamed).collect()
    assert sorted((r.group, r.key, r.rank, r.other, round(r.score, 6)) for r in got) == sorted(want)
    assert {r.key: [round(x, 6) for x in r.scores] for r in score_matrix.rows(a, b, held=held, streamed=streamed).collect()} == whole
    assert score_matrix.top(a.limit(0), b, 4).count() == 0


def test_score_matrix_refuses_unlike_lengths(frame):
    a = frame([("a", 1, [1.0, 2.0])], "group string, key long, vector array<float>")
    with pytest.raises(Exception, match="differ in length"):
        score_matrix.top(a, a.withColumn("vector", F.array(F.lit(1.0))), 2).collect()
