"""Frame tables: one row per frame, by clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_pool(frames: DataFrame, clips: DataFrame, candidates: int) -> DataFrame:
    """The first frame at or after each bin's midpoint, once each, inside ``[start, end)``.

    ``frames(clip, t, ...)``, ``clips(clip, start, end)``. A forward as-of join in counting form: a frame is
    taken if more midpoints lie at or before it than at or before the frame before it.
    """
    inside = frames.join(clips, "clip").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    width = (F.col("end") - F.col("start")) / candidates
    guess = F.floor((F.col("t") - F.col("start")) / width - 0.5).cast("int")
    middle = lambda i: F.col("start") + (i + 0.5) * (F.col("end") - F.col("start")) / candidates
    # the guess is right but for rounding: look at it and both beside it
    passed = lambda i: ((i >= 0) & (i < candidates) & (middle(i) <= F.col("t"))).cast("int")
    count = F.greatest(F.lit(0), F.least(F.lit(candidates), guess - 1)) + passed(guess - 1) + passed(guess) + passed(guess + 1)
    counted = inside.withColumn("passed", F.least(F.lit(candidates), count))
    before = F.lag("passed", 1, 0).over(Window.partitionBy("clip").orderBy("t"))
    return counted.withColumn("before", before).where(F.col("passed") > F.col("before")).select(*frames.columns)


def neighbors(frames: DataFrame, seconds: float) -> DataFrame:
    """Each frame with the earliest and latest frame index at most ``seconds`` away."""
    near = f"OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN {float(seconds)}D PRECEDING AND {float(seconds)}D FOLLOWING)"
    return frames.withColumn("earliest", F.expr(f"min(idx) {near}")).withColumn("latest", F.expr(f"max(idx) {near}"))


def top_frames(frames: DataFrame, k: int) -> DataFrame:
    """The k frames of highest score of each clip, of equals the smaller index."""
    order = Window.partitionBy("clip").orderBy(F.desc("score"), "idx")
    return frames.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def arrays(frames: DataFrame, *columns: str) -> DataFrame:
    """One row per clip, with ``columns`` as arrays in index order."""
    packed = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    return frames.groupBy("clip").agg(packed.alias("f")).select("clip", *[F.col(f"f.{c}").alias(c) for c in columns])
