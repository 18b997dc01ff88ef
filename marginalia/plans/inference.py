"""Gated inference: select frames, answer, and if the margin is small select more and answer again.

The whole plan is column expressions: with the stand-in models a row never leaves the JVM. Real models come
in as an ``Answerer`` or ``Scorer`` whose columns are pandas functions.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import Config
from marginalia.functions import answers, selectors


class Answerer(Protocol):
    def scores(self, id: Column, question: Column, choices: Column, ids: Column, timestamps: Column) -> Column: ...
    def tokens(self, ids: Column) -> Column: ...


class Scorer(Protocol):
    def relevance(self, text: Column, times: Column) -> Column: ...


class MockAnswerer:
    """Deterministic answers of no meaning."""

    def scores(self, id, question, choices, ids, timestamps):
        return answers.mock_scores(id, F.size(choices), F.size(ids))

    def tokens(self, ids):
        return answers.mock_tokens(F.size(ids))


class MockScorer:
    def relevance(self, text, times):
        return answers.mock_relevance(text, F.size(times))


def with_mock_pool(manifest: DataFrame, candidates: int) -> DataFrame:
    """Candidate times every quarter of a second from the clip's start."""
    return manifest.withColumn("times", F.transform(selectors.indices(candidates), lambda i: F.col("start") + 0.25 * i))


class ColumnModels:
    """An answerer and a scorer of column functions, as steps of a plan."""

    def __init__(self, answerer: Answerer | None = None, scorer: Scorer | None = None):
        self.answerer, self.scorer = answerer or MockAnswerer(), scorer or MockScorer()

    def score(self, df: DataFrame, texts: dict[str, Column], when: Column | None = None) -> DataFrame:
        """Add a row of scores for each named text; it must have a finite score for each frame."""
        for name, text in texts.items():
            row = checked_row(self.scorer.relevance(text, F.col("times")), name)
            df = df.withColumn(name, row if when is None else F.when(when, row))
        return df

    def call(self, df: DataFrame, name: str, ids: str, max_tokens: int) -> DataFrame:
        """Add the call record of answering with the frames of column ``ids``."""
        stamps = stamps_of(ids)
        scores = self.answerer.scores(F.col("id"), F.col("question"), F.col("choices"), F.col(ids), stamps)
        return df.withColumn(name, record(scores, self.answerer.tokens(F.col(ids)), ids, stamps, max_tokens))


#: What a scorer's row was asked about.
TEXTS = {"relevance": "the question", "rq": "the question", "ra": "the first option", "rb": "the second option"}


def checked_row(row: Column, name: str) -> Column:
    """A scorer's row for a text, which must have a finite score for each frame."""
    fits = lambda x: F.coalesce((F.size(x) == F.size("times")) & selectors.finite(x), F.lit(False))
    return selectors.let(row, lambda x: F.when(fits(x), x).otherwise(F.raise_error(F.lit(f"scores of {TEXTS[name]} must be finite, one for each frame"))))


def stamps_of(ids: str) -> Column:
    return F.transform(F.col(ids), lambda i: F.get(F.col("times"), i))


def record(scores: Column, tokens: Column, ids: str, stamps: Column, max_tokens: int) -> Column:
    """A call's record, checked; null where there are no frames."""
    checked = selectors.let(scores, lambda s: F.when(answers.valid(s, F.size("choices")), s).otherwise(F.raise_error(F.lit("an answerer must return one finite probability per choice, together 1"))))
    tokens = F.when(tokens <= max_tokens, tokens).otherwise(F.raise_error(F.lit(f"an input has more than {max_tokens} tokens")))  # never cut
    return F.when(F.col(ids).isNotNull(), F.struct(checked.alias("scores"), tokens.alias("input_tokens"), F.col(ids).alias("frame_indices"), stamps.alias("timestamps")))


def first_frames(df: DataFrame, config: Config, models: ColumnModels) -> DataFrame:
    """Frames of the first call, as ``ids1``."""
    n, none = F.size("times"), F.lit(None).cast("string")
    if config.method in ("uniform", "evidence", "uniform_refine"):
        frames = config.frames if config.method == "uniform" else config.initial_frames
        return df.withColumn("ids1", selectors.uniform(n, frames)).withColumn("aks_status", none)
    df = models.score(df, {"relevance": F.col("question")})
    if config.method == "clip_topk":
        return df.withColumn("ids1", selectors.topk(F.col("relevance"), config.frames)).withColumn("aks_status", none)
    found = selectors.segment_quota(F.col("relevance"), config.frames, config.aks_t1, config.aks_t2, config.aks_depth)
    return df.withColumn("segments", found).withColumn("ids1", F.col("segments.ids")).withColumn("aks_status", F.col("segments.status"))


def second_frames(df: DataFrame, config: Config, models: ColumnModels) -> DataFrame:
    """Frames of the second call, null where there is none."""
    empty = F.array().cast("array<int>")
    if config.method == "uniform_refine":
        more = selectors.gap_fill(F.size("times"), F.col("ids1"), config.frames)
        return df.withColumn("ids2", F.when(F.col("refined"), more)).withColumn("anchors", empty).withColumn("competitors", F.lit(None).cast("array<int>"))
    if config.method == "evidence":
        df = df.withColumn("competitors", F.when(F.col("refined"), answers.competitors(F.col("call1.scores"))))
        text = lambda i: F.concat_ws(" ", "question", F.get(F.col("choices"), F.get(F.col("competitors"), F.lit(i))))
        df = models.score(df, {"rq": F.col("question"), "ra": text(0), "rb": text(1)}, F.col("refined"))
        found = selectors.evidence(F.col("times"), F.col("ids1"), config.frames, F.col("rq"), F.col("ra"), F.col("rb"), config.neighbor_seconds, config.relevance_weight)
        df = df.withColumn("found", F.when(F.col("refined"), found))
        return df.withColumn("ids2", F.col("found.ids")).withColumn("anchors", F.coalesce("found.anchors", empty))
    return df.withColumn("ids2", F.lit(None).cast("array<int>")).withColumn("anchors", empty).withColumn("competitors", F.lit(None).cast("array<int>"))


def gated(df: DataFrame, config: Config) -> DataFrame:
    """Add ``initial_margin`` and ``refined``, whether a second call follows."""
    df = df.withColumn("initial_margin", answers.margin(F.col("call1.scores")))
    gate = (F.col("initial_margin") < config.margin_threshold) & (F.size("ids1") < F.least(F.lit(config.frames), F.size("times")))
    return df.withColumn("refined", gate if config.method in ("evidence", "uniform_refine") else F.lit(False))


def infer(pool: DataFrame, config: Config, answerer: Answerer | None = None, scorer: Scorer | None = None) -> DataFrame:
    """The trace of every row of ``pool(id, question, choices, times, ...)``, its other columns kept.

    At most two calls. The answer column, if there, is never read.
    """
    models = ColumnModels(answerer, scorer)
    df = gated(models.call(first_frames(pool, config, models), "call1", "ids1", config.max_input_tokens), config)
    return traced(models.call(second_frames(df, config, models), "call2", "ids2", config.max_input_tokens), config, pool.columns)


def traced(df: DataFrame, config: Config, kept: list[str]) -> DataFrame:
    """The trace of rows whose calls are made, and the columns ``kept``."""
    df = df.withColumn("calls", F.filter(F.array("call1", "call2"), lambda c: c.isNotNull())).withColumn("scores", F.element_at("calls", -1)["scores"])
    queries = F.lit(1 if config.method in ("clip_topk", "aks") else 0)
    if config.method == "evidence":
        queries = F.when(F.col("refined"), 1 + F.size("choices")).otherwise(0)
    total = lambda f: F.aggregate("calls", F.lit(0), lambda a, c: a + f(c))
    trace = {
        "method": F.lit(config.method),
        "candidate_frames": F.size("times"),
        "selector_queries": queries.cast("int"),
        "anchors": F.col("anchors"),
        "aks_status": F.col("aks_status"),
        "initial_margin": F.col("initial_margin"),
        "refined": F.col("refined"),
        "competitors": F.col("competitors"),
        "prediction": answers.argmax(F.col("scores")),
        "scores": F.col("scores"),
        "calls": F.col("calls"),
        "input_tokens": total(lambda c: c["input_tokens"]),
        "frame_presentations": total(lambda c: F.size(c["frame_indices"])),
        "final_frames": F.size(F.element_at("calls", -1)["frame_indices"]),
    }
    return df.select(*[c for c in kept if c not in trace and c != "times"], *[value.alias(name) for name, value in trace.items()])


def results(manifest: DataFrame, config: Config, elapsed: Column | None = None, node: str = "local") -> DataFrame:
    """Result rows of a run with the stand-in models over a mock pool."""
    found, gib = infer(with_mock_pool(manifest, config.candidate_frames), config), F.lit(None).cast("double")
    return result_rows(found, F.lit(0.0) if elapsed is None else elapsed, gib, gib, F.struct(F.lit(node).alias("node"), F.lit("float32").alias("resolved_dtype")))


def result_rows(found: DataFrame, elapsed: Column, allocated: Column, reserved: Column, execution: Column) -> DataFrame:
    """A trace as result rows, in the order of their file format."""
    return found.select(
        "id", "video", "dataset", "split", "question_type", "answer", "start",
        F.when(F.col("answer").isNotNull(), F.col("prediction") == F.col("answer")).alias("correct"),
        *["method", "prediction", "candidate_frames", "selector_queries", "input_tokens", "frame_presentations", "final_frames", "initial_margin", "refined", "scores", "calls", "anchors", "competitors", "aks_status"],
        elapsed.alias("elapsed_seconds"), allocated.alias("peak_vram_allocated_gib"), reserved.alias("peak_vram_reserved_gib"), execution.alias("execution"),
    )
