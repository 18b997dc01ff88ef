"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

# Fields of the file formats, in their order.
MANIFEST = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("dataset", _S, False),
        T.StructField("split", _S, False),
        T.StructField("video", _S, False),
        T.StructField("video_sha256", _S, False),
        T.StructField("question", _S, False),
        T.StructField("choices", T.ArrayType(_S), False),
        T.StructField("answer", _I),
        T.StructField("question_type", _S, False),
        T.StructField("start", _D, False),
        T.StructField("end", _D),
    ]
)
#: What inference may see: never the answer.
PUBLIC = ("id", "question", "choices")
FLAT_ANNOTATION = T.StructType([T.StructField(c, _S) for c in ("video", "qid", "question", "answer", "type", "a0", "a1", "a2", "a3", "a4")])
NESTED_ANNOTATION = T.StructType(
    [
        T.StructField("question_id", _S),
        T.StructField("video_id", _S),
        T.StructField("start", _D),
        T.StructField("end", _D),
        T.StructField("question", _S),
        T.StructField("answer", _S),
        T.StructField("choices", T.ArrayType(T.StructType([T.StructField("choice_id", _I), T.StructField("choice", _S)]))),
    ]
)
CALL = T.StructType([T.StructField("scores", T.ArrayType(_D)), T.StructField("input_tokens", _I), T.StructField("frame_indices", T.ArrayType(_I)), T.StructField("timestamps", T.ArrayType(_D))])
EVENT = T.StructType([T.StructField("event", _S), T.StructField("detail", _S)])
#: Columns of the CSV export, in order.
EXPORT = ("id", "video", "dataset", "split", "question_type", "prediction", "answer", "correct", "elapsed_seconds", "input_tokens", "final_frames", "refined", "peak_vram_allocated_gib")
