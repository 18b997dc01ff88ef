"""Scores of options and frames as column functions, with deterministic stand-ins for models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.selectors import finite, indices, let
from marginalia.functions.text import three_decimals


def argmax(scores: Column) -> Column:
    """Index of the highest score, of equals the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def margin(scores: Column) -> Column:
    """Highest score less the next."""
    falling = F.sort_array(scores, False)
    return F.get(falling, F.lit(0)) - F.get(falling, F.lit(1))


def competitors(scores: Column) -> Column:
    """Indices of the two highest scores, of equals the first."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, 2), lambda x: x["i"].cast("int"))


def valid(scores: Column, n_choices) -> Column:
    """One finite probability per choice, together 1 within a ten-thousandth."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce((F.size(scores) == n_choices) & finite(scores) & F.forall(scores, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= 1e-4), F.lit(False))


def normalised(values: Column) -> Column:
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return let(values, lambda xs: let(sum_of(xs), lambda total: F.transform(xs, lambda x: x / total)))


def softmax(logits: Column, n) -> Column:
    """Probabilities over the first n logits."""
    return normalised(let(F.slice(logits, 1, n), lambda some: let(F.array_max(some), lambda top: F.transform(some, lambda x: F.exp(x - top)))))


def mock_scores(id: Column, n_choices: Column, n_frames) -> Column:
    """The stand-in answerer: choice i scores by byte i of the SHA-256 of ``id:frames``."""
    digest = F.sha2(F.concat_ws(":", id, F.lit(n_frames).cast("string") if not isinstance(n_frames, Column) else n_frames.cast("string")).cast("binary"), 256)
    byte = lambda text, i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("double")
    return normalised(let(digest, lambda text: F.transform(indices(n_choices), lambda i: 1 + byte(text, i) / 255)))


def mock_tokens(n_frames: Column) -> Column:
    return (100 + 10 * n_frames).cast("int")


def mock_relevance(text: Column, n) -> Column:
    """The stand-in scorer: a wave over frames, shifted by the text's length in code points."""
    return let(F.length(text), lambda size: F.transform(indices(n), lambda i: F.sin(i * F.lit(0.7).cast("double") + size)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def prompt(question: Column, choices: Column) -> Column:
    """The protocol's prompt text (fixed wording)."""
    lettered = F.transform(choices, lambda x, i: F.concat(F.char(65 + i), F.lit(". "), x))
    head = "Answer the multiple-choice question using the video evidence. Timestamps are seconds in the source video. Select exactly one option letter.\nQuestion: "
    return F.concat(F.lit(head), question, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\nAnswer:"))


def captions(times: Column) -> Column:
    """The text before each frame of an input of many images (fixed wording)."""
    return F.transform(times, lambda t: F.concat(F.lit("Frame at "), three_decimals(t), F.lit("s:")))


def timeline(times: Column) -> Column:
    """Frame times on a virtual timeline of one frame a second, so that uneven ones survive."""
    return F.struct(F.size(times).alias("total_num_frames"), F.lit(1.0).alias("fps"), times.alias("frames_indices"), (F.array_max(times) + 0.001).alias("duration"))
