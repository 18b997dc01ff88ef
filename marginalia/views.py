"""Question-answering tables derived from the driver's general ones, so that every operator has an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.config import Config
from marginalia.plans import inference

TYPES = {"nextqa": ("CW", "CH", "TN", "TC", "TP", "DC", "DL", "DO"), "star": ("Interaction", "Sequence", "Prediction", "Feasibility")}
CHOICES = ("Open", "Close", "Lift", "Drop", "Turn")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions, their sources as videos, labels as answers; ``n_chars`` is kept for stand-in timings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    even, n, half = F.col("doc_id") % 2 == 0, (2 + F.col("doc_id") % 4).cast("int"), F.floor(F.col("doc_id") / 2)
    start = 1.5 * (F.col("doc_id") % 7)
    pick = lambda kind: F.get(F.array(*[F.lit(x) for x in TYPES[kind]]), (half % len(TYPES[kind])).cast("int"))
    video = F.concat("source", F.lit(".mp4"))
    return docs.select(
        F.when(even, F.concat_ws(":", F.lit("nextqa:val"), "source", "doc_id")).otherwise(F.concat_ws(":", F.lit("star:val"), "doc_id")).alias("id"),
        F.when(even, "nextqa").otherwise("star").alias("dataset"),
        F.lit("val").alias("split"),
        video.alias("video"),
        F.sha2(video.cast("binary"), 256).alias("video_sha256"),
        F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("question"),
        F.slice(F.array(*[F.lit(x) for x in CHOICES]), 1, n).alias("choices"),
        ((F.col("doc_id") + 2 * F.col("quality") + F.col("toxic")) % n).cast("int").alias("answer"),
        F.when(even, pick("nextqa")).otherwise(pick("star")).alias("question_type"),
        F.when(even, 0.0).otherwise(start).alias("start"),
        F.when(~even, start + 10 + F.col("n_chars") % 20).alias("end"),
        "n_chars",
        "doc_id",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: users as clips, hours since the user's first event, a score."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("clip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    by = Window.partitionBy("clip")
    order = by.orderBy("us", "event_id")
    return events.select("clip", (F.row_number().over(order) - 1).alias("idx"), ((F.col("us") - F.min("us").over(by)) / 3.6e9).alias("t"), (F.col("value") / 500).alias("score"))


def run(spark: SparkSession, sf_dir: str, method: str = "uniform", labelled: bool = False) -> DataFrame:
    """A run of the stand-in models over the manifest; characters stand in for milliseconds."""
    rows = manifest(spark, sf_dir)
    rows = rows.where("answer is not null") if labelled else rows
    config = Config(backend="mock", method=method, margin_threshold=1.0, limit=0)
    return inference.results(rows.drop("doc_id"), config, F.col("n_chars") / 1000)
