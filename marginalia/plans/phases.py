"""Gated inference in two phases, with models that live in Arrow functions.

The first call of every row is made and written; only rows that the gate lets through go to the second phase,
whose calls are written too; their union is the run. A model is loaded once in each Python worker and gets
batches of bounded bytes, with the frames of each row from a table of frames.
"""

from __future__ import annotations

import socket
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import Config
from marginalia.operators import score_matrix
from marginalia.operators.frames import candidate_pool
from marginalia.plans.inference import ColumnModels, checked_row, first_frames, gated, record, result_rows, second_frames, stamps_of, traced
from marginalia.schema import CALL
from marginalia.sources.scratch import written

#: Bytes of frames and texts that a model is given at once.
BATCH_BYTES = 8 << 20
#: Bytes of frames, or of their features, that are sent to every worker.
BROADCAST_BYTES = 16 << 20
COST = "struct<seconds:double,allocated:double,reserved:double,node:string,dtype:string>"


class Asked(NamedTuple):
    """A question with the frames that are shown, in order."""

    id: str
    question: str
    choices: list[str]
    frames: np.ndarray
    times: list[float]


class Model(Protocol):
    """A loaded model. ``answer`` gives scores and input tokens of each question, ``encode`` and ``features`` vectors of one space."""

    dtype: str

    def answer(self, asked: list[Asked]) -> list[tuple[list[float], int]]: ...
    def encode(self, texts: list[str]) -> np.ndarray: ...
    def features(self, frames: np.ndarray) -> np.ndarray: ...
    def reset_peak(self) -> None: ...
    def measurements(self) -> dict[str, float]: ...


_loaded: dict[str, Model] = {}


def balanced(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes (one row at least)."""
    a, upto = 0, np.append(0, np.cumsum(sizes))
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each row's texts."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class ArrowModels:
    """A model in Arrow functions as steps of a plan over rows of unique ids.

    ``frames(clip, idx, frame)`` has each clip's frames, ``clip`` the rows' column that names theirs. Frames of at
    most ``broadcast_bytes`` in all are sent to the workers. More are joined with the rows that ask for them: a clip that
    many rows ask about is met in as many parts as they need (``per_part`` frames asked of a clip in one), so that no
    task joins all of them.
    """

    def __init__(self, load: Callable[[], Model], frames: DataFrame, clip: str = "clip", batch_bytes: int = BATCH_BYTES, per_part: int = 1 << 20, broadcast_bytes: int = BROADCAST_BYTES):
        self.load, self.clip, self.batch_bytes, self.per_part, self.broadcast_bytes = load, clip, batch_bytes, per_part, broadcast_bytes
        self._sent: dict[str, object] = {}
        self.frames = frames.select("clip", "idx", F.col("frame").cast("array<float>").alias("frame"))
        self.key, self._features = uuid.uuid4().hex, None

    def model(self) -> Callable[[], Model]:
        """A function that gives the worker's model, loaded at its first use there."""
        load, key = self.load, self.key

        def given() -> Model:
            from marginalia.plans import phases

            if key not in phases._loaded:
                phases._loaded.clear()
                phases._loaded[key] = load()
            return phases._loaded[key]

        return given

    def _shown(self, df: DataFrame, ids: str) -> DataFrame:
        """``id, shown``: the frames of each row in order of ``ids``."""
        asked = df.where(F.col(ids).isNotNull()).select("id", F.col(self.clip).alias("clip"), F.posexplode(ids).alias("pos", "idx"))
        parts = asked.groupBy("clip").agg(F.ceil(F.count("*") / F.lit(self.per_part)).cast("int").alias("parts"))  # a row a clip
        asked = asked.join(parts, "clip").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        held = self.frames.join(parts, "clip").select("clip", "idx", "frame", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = asked.join(held, ["clip", "idx", "part"], "left")
        return met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "frame"))).alias("s")).select("id", F.col("s.frame").alias("shown"))

    def _small(self, rows: DataFrame, column: str):
        """A broadcast of ``{clip: {idx: vector}}`` of ``rows(clip, idx, column)`` if they are small, else None; found out once."""
        if column not in self._sent:
            size = rows.agg(F.sum(F.size(column) * (4 if column == "frame" else 8) + 64).alias("n")).first()["n"] or 0
            found = None
            if size <= self.broadcast_bytes:
                clips: dict = {}
                for r in rows.select("clip", "idx", column).toArrow().to_batches():
                    for clip, idx, v in zip(r.column("clip").to_pylist(), r.column("idx").to_pylist(), r.column(column).to_numpy(zero_copy_only=False), strict=True):
                        clips.setdefault(clip, {})[idx] = np.asarray(v)
                found = rows.sparkSession.sparkContext.broadcast(clips)
            self._sent[column] = found
        return self._sent[column]

    def call(self, df: DataFrame, name: str, ids: str, max_tokens: int) -> DataFrame:
        """Add the call record of answering with the frames of column ``ids``, and what it cost as ``<name>_cost``."""
        given, sent, clip_col = df.withColumn("stamps", stamps_of(ids)), self._small(self.frames, "frame"), self.clip
        given = given.withColumn("shown", F.lit(None).cast("array<array<float>>")).where(F.col(ids).isNotNull()) if sent else given.join(self._shown(df, ids), "id")
        model, limit, host = self.model(), self.batch_bytes, socket.gethostname

        def frames_of(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
            """The frames of each row, and their bytes."""
            if sent:
                clips = sent.value
                found = [[clips.get(c, {}).get(i) for i in some] for c, some in zip(batch.column(clip_col).to_pylist(), batch.column(ids).to_pylist(), strict=True)]
                return found, np.array([sum(f.nbytes for f in x if f is not None) for x in found], np.int64)
            shown = batch.column("shown")
            return shown.to_pylist(), 4 * np.diff(pc.list_flatten(shown).offsets.to_numpy()[shown.offsets.to_numpy() - shown.offsets[0].as_py()])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
                shown, size = frames_of(batch)
                at = 0
                for part in balanced(batch, size + _bytes(batch.column("question")), limit):
                    yield answered(part, shown[at : at + part.num_rows])
                    at += part.num_rows

        def answered(part: pa.RecordBatch, shown: list) -> pa.RecordBatch:
            loaded = model()
            columns = [*[part.column(c).to_pylist() for c in ("id", "question", "choices")], shown, part.column("stamps").to_pylist()]
            for row, some in zip(columns[0], shown, strict=True):
                if any(x is None for x in some):
                    raise ValueError(f"a frame of {row} is missing")
            asked = [Asked(i, q, c, np.array(f, np.float32), t) for i, q, c, f, t in zip(*columns, strict=True)]
            loaded.reset_peak()
            began = time.perf_counter()
            got = loaded.answer(asked)
            each, peak = (time.perf_counter() - began) / len(asked), loaded.measurements()
            cost = {"seconds": each, "allocated": peak["peak_vram_allocated_gib"], "reserved": peak["peak_vram_reserved_gib"], "node": host(), "dtype": loaded.dtype}
            kinds = pa.struct([("seconds", pa.float64()), ("allocated", pa.float64()), ("reserved", pa.float64()), ("node", pa.string()), ("dtype", pa.string())])
            more = {"_scores": pa.array([list(map(float, s)) for s, _ in got], pa.list_(pa.float64())), "_tokens": pa.array([n for _, n in got], pa.int32()), f"{name}_cost": pa.array([cost] * len(asked), kinds)}
            kept = [c for c in part.schema.names if c != "shown"]
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *more.values()], [*kept, *more])

        schema = given.drop("shown").select("*", F.lit(None).cast("array<double>").alias("_scores"), F.lit(None).cast("int").alias("_tokens"), F.lit(None).cast(COST).alias(f"{name}_cost")).schema
        out = given.mapInArrow(run, schema)
        return out.withColumn(name, record(F.col("_scores"), F.col("_tokens"), ids, F.col("stamps"), max_tokens)).drop("_scores", "_tokens", "stamps")

    def features(self) -> DataFrame:
        """``clip, idx, vector`` of all frames, computed once."""
        if self._features is None:
            model = self.model()

            def run(batches):
                for batch in batches:
                    if batch.num_rows:
                        column = batch.column("frame")
                        found = model().features(np.stack(column.to_numpy(zero_copy_only=False)))
                        yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), pa.array(list(found.astype(np.float64)), pa.list_(pa.float64()))], ["clip", "idx", "vector"])

            kind = self.frames.schema["clip"].dataType.simpleString()
            self._features = written(self.frames.select("clip", F.col("idx").cast("long").alias("idx"), "frame").mapInArrow(run, f"clip {kind}, idx long, vector array<double>"), "features")
        return self._features

    def score(self, df: DataFrame, texts: dict[str, Column], when: Column | None = None) -> DataFrame:
        """Add a row of scores for each named text: its cosine with every frame of the row's clip, in order."""
        model, limit = self.model(), self.batch_bytes
        if sent := self._small(self.features(), "vector"):
            return self._scored(df, texts, when, sent)
        rows = df if when is None else df.where(when)
        asked = rows.select("id", F.col(self.clip).alias("clip"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in texts.items()])).alias("t")).select("id", "clip", "t.*")

        def run(batches):
            for batch in batches:
                for part in balanced(batch, _bytes(batch.column("text")), limit):
                    found = model().encode(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "clip", "name")], pa.array(list(found.astype(np.float64)), pa.list_(pa.float64()))], ["id", "clip", "name", "vector"])

        kind = self.frames.schema["clip"].dataType.simpleString()
        encoded = asked.mapInArrow(run, f"id string, clip {kind}, name string, vector array<double>")
        keyed = encoded.select("clip", F.concat_ws(":", "name", "id").alias("key"), "vector")
        found = score_matrix.rows(keyed, self.features(), group="clip", other="idx")
        found = found.select(F.substring_index("key", ":", 1).alias("name"), F.expr("substring(key, instr(key, ':') + 1)").alias("id"), "scores")
        wide = found.groupBy("id").agg(*[F.first(F.when(F.col("name") == n, F.col("scores")), ignorenulls=True).alias(n) for n in texts])
        out = df.join(wide, "id", "left")
        for name in texts:
            out = out.withColumn(name, checked_row(F.col(name), name) if when is None else F.when(when, checked_row(F.col(name), name)))
        return out


    def _scored(self, df: DataFrame, texts: dict[str, Column], when: Column | None, sent) -> DataFrame:
        """The same with all features at hand: no row is moved."""
        model, clip_col, names = self.model(), self.clip, list(texts)
        for name, text in texts.items():
            df = df.withColumn(f"_{name}", text if when is None else F.when(when, text))

        def run(batches):
            units: dict = {}

            def unit(clip) -> np.ndarray:
                if clip not in units:
                    found = sent.value.get(clip, {})
                    m = np.stack([found[i] for i in sorted(found)]) if found else np.zeros((0, 1))
                    units[clip] = m / np.sqrt((m * m).sum(1))[:, None]
                return units[clip]

            for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
                clips, more = batch.column(clip_col).to_pylist(), []
                for name in names:
                    asked = batch.column(f"_{name}").to_pylist()
                    some = [i for i, x in enumerate(asked) if x is not None]
                    vectors = model().encode([asked[i] for i in some]) if some else []
                    scores = [None] * len(asked)
                    for i, v in zip(some, vectors, strict=True):
                        frames = unit(clips[i])
                        scores[i] = frames @ (v / np.sqrt(v @ v)) if len(frames) else np.zeros(0)
                    more.append(pa.array(scores, pa.list_(pa.float64())))
                kept = [c for c in batch.schema.names if c not in [f"_{n}" for n in names]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *more], [*kept, *names])

        plain = df.drop(*[f"_{n}" for n in names])
        out = df.mapInArrow(run, plain.select("*", *[F.lit(None).cast("array<double>").alias(n) for n in names]).schema)
        for name in names:
            out = out.withColumn(name, checked_row(F.col(name), name) if when is None else F.when(when, checked_row(F.col(name), name)))
        return out


def infer(pool: DataFrame, config: Config, models: ColumnModels | ArrowModels) -> DataFrame:
    """The trace of every row of ``pool``, as of ``inference.infer``; the answerer sees each row once, and again only where the gate says so."""
    one = written(gated(models.call(first_frames(pool, config, models), "call1", "ids1", config.max_input_tokens), config), "first-calls")
    cost = lambda df: [c for c in df.columns if c.endswith("_cost")]
    kept = [*pool.columns, *cost(one)]
    none = lambda kind: F.lit(None).cast(kind)
    sure = one.where("not refined").withColumn("anchors", F.array().cast("array<int>")).withColumn("competitors", none("array<int>")).withColumn("call2", none(CALL))
    if config.method not in ("evidence", "uniform_refine"):
        return traced(sure, config, kept)
    more = models.call(second_frames(one.where("refined"), config, models), "call2", "ids2", config.max_input_tokens)
    two = written(more.select(*one.columns, "anchors", "competitors", "call2", *[c for c in cost(more) if c not in kept]), "second-calls")
    return traced(sure.unionByName(two, allowMissingColumns=True), config, [*kept, *[c for c in cost(two) if c not in kept]])


def results(pool: DataFrame, config: Config, models: ArrowModels) -> DataFrame:
    """Result rows of a run with a model: measured seconds, the greatest peaks, and where the last call ran."""
    found = infer(pool, config, models)
    costs = [F.col(c) for c in found.columns if c.endswith("_cost")]
    most = lambda field: F.greatest(*[c[field] for c in costs]) if len(costs) > 1 else costs[0][field]
    seconds = sum((F.coalesce(c["seconds"], F.lit(0.0)) for c in costs), F.lit(0.0))
    last = F.coalesce(*reversed(costs))
    return result_rows(found, seconds, most("allocated"), most("reserved"), F.struct(last["node"].alias("node"), last["dtype"].alias("resolved_dtype")))


def pool(manifest: DataFrame, frames: DataFrame, candidates: int) -> tuple[DataFrame, DataFrame]:
    """``manifest`` with ``clip`` and ``times``, and ``clip, idx, frame`` of its clips, from ``frames(video, t, frame)``.

    A clip is what a question is about: a video from start to end (null: to its last frame). It has the first frame
    at or after each of ``candidates`` evenly spaced times. A question whose clip has no frame raises.
    """
    last = frames.groupBy("video").agg(F.max("t").alias("last"))  # an end leaves out the frame there
    asked = manifest.select("video", "start", "end").distinct().join(last, "video", "left").select("video", _clip().alias("clip"), "start", F.coalesce("end", F.col("last") + 1).alias("end"))
    met = frames.join(asked.select("video", "clip"), "video").select("clip", "t", "frame")
    picked = candidate_pool(met, asked.select("clip", "start", "end"), candidates)
    numbered = picked.select("clip", (F.row_number().over(Window.partitionBy("clip").orderBy("t")) - 1).alias("idx"), "t", "frame")  # candidates a clip at most
    held = written(numbered, "pool")
    times = held.groupBy("clip").agg(F.array_sort(F.collect_list("t")).alias("times"))
    rows = manifest.withColumn("clip", _clip()).join(times, "clip", "left")
    missing = F.raise_error(F.concat(F.lit("no frames for "), "id"))
    return rows.withColumn("times", F.when(F.col("times").isNotNull(), F.col("times")).otherwise(missing)), held.drop("t")


def _clip() -> Column:
    return F.concat_ws("|", "video", F.col("start").cast("string"), F.col("end").cast("string"))


def runner(load: Callable[[], Model], frames: DataFrame) -> Callable[[DataFrame, Config], DataFrame]:
    """Result rows of a manifest's rows with a model and a table of frames, as sessions take it."""

    def infer_rows(manifest: DataFrame, config: Config) -> DataFrame:
        rows, held = pool(manifest, frames, config.candidate_frames)
        return results(rows, config, ArrowModels(load, held))

    return infer_rows
