"""Annotation files as manifest rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import is_video, slashed, stem, strip
from marginalia.operators.rules import duplicates, require
from marginalia.schema import FLAT_ANNOTATION, MANIFEST, NESTED_ANNOTATION


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return need(df, FLAT_ANNOTATION.names)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return need(spark.read.parquet(path), FLAT_ANNOTATION.names)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of nested annotations; only the fields of the schema are read."""
    return spark.read.schema(NESTED_ANNOTATION).json(path, multiLine=True)


def need(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df


def flat(df: DataFrame, split: str) -> DataFrame:
    """Rows with choices a0 to a4 and the answer's index; a null choice stays null and breaks a rule later."""
    c = lambda name: F.col(name).cast("string")
    return df.select(
        F.concat_ws(":", F.lit("nextqa"), F.lit(split), c("video"), c("qid")).alias("id"),
        F.lit("nextqa").alias("dataset"),
        F.lit(split).alias("split"),
        c("video").alias("video_key"),
        c("question").alias("question"),
        F.array(*[c(f"a{i}") for i in range(5)]).alias("choices"),
        F.nullif(c("answer"), F.lit("")).cast("int").alias("answer"),
        c("type").alias("question_type"),
        F.lit(0.0).alias("start"),
        F.lit(None).cast("double").alias("end"),
    )


def nested_choices(choices, answer):
    """Choice texts in order of their number, and the index of the one that is the answer's text; -1 if not just one is."""
    ordered = F.transform(F.array_sort(choices, lambda a, b: (a["choice_id"].cast("int") - b["choice_id"].cast("int"))), lambda x: x["choice"])
    hits = F.filter(F.transform(ordered, lambda x, i: F.when(strip(x) == strip(answer), i)), lambda i: i.isNotNull())
    index = F.when(answer.isNull(), F.lit(None)).when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(-1)
    return ordered, index.cast("int")


def nested(df: DataFrame, split: str) -> DataFrame:
    """Rows with numbered choices and the answer's text; repeated choice numbers give no choices, which breaks a rule later."""
    ordered, index = nested_choices(F.col("choices"), F.col("answer"))
    ids = F.transform("choices", lambda x: x["choice_id"])
    return df.select(
        F.concat_ws(":", F.lit("star"), F.lit(split), F.col("question_id").cast("string")).alias("id"),
        F.lit("star").alias("dataset"),
        F.lit(split).alias("split"),
        F.col("video_id").cast("string").alias("video_key"),
        F.col("question"),
        F.when(F.size(F.array_distinct(ids)) == F.size(ids), ordered).alias("choices"),
        index.alias("answer"),
        F.substring_index("question_id", "_", 1).alias("question_type"),
        F.col("start").cast("double").alias("start"),
        F.col("end").cast("double").alias("end"),
    )


ADAPTERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"nextqa": flat, "star": nested}


def read_remap(spark: SparkSession, path: str | None) -> DataFrame:
    """A JSON object of video keys to paths, as ``video_key, path``."""
    pairs = list(json.loads(Path(path).read_text(encoding="utf-8-sig")).items()) if path else []
    return spark.createDataFrame(pairs, "video_key string, path string")


def remapped(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """Video keys replaced by their path's stem where there is one, else by their own."""
    return rows.join(remap, "video_key", "left").withColumn("stem", stem(F.coalesce("path", "video_key"))).drop("path")


def video_index(spark: SparkSession, root: str) -> DataFrame:
    """``stem, video, video_sha256`` of all video files below a folder, each read and hashed once.

    A binary column holds up to 2 GB; larger files need an index made elsewhere.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(is_video(F.col("path")))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    found = files.select(slashed(F.col("path")).alias("path"), F.sha2("content", 256).alias("video_sha256"))
    index = found.select(F.substring("path", F.instr("path", base.split(":", 1)[-1].lstrip("/")) + len(base.split(":", 1)[-1].lstrip("/")), F.length("path")).alias("video"), "video_sha256")
    return index.select(stem(F.col("video")).alias("stem"), "video", "video_sha256")


def resolved(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with their video's path and digest; raises if a stem is ambiguous or a row has no video."""
    if twice := duplicates(index, "stem").limit(5).collect():
        raise ValueError("ambiguous videos: " + ", ".join(r["stem"] for r in twice))
    if lost := unresolved(rows, index).select("id").limit(5).collect():
        raise ValueError("no video for: " + ", ".join(r["id"] for r in lost))
    return rows.join(index, "stem").select(*MANIFEST.names)


def unresolved(rows: DataFrame, index: DataFrame) -> DataFrame:
    return rows.join(index, "stem", "left_anti")


def prepare(spark: SparkSession, dataset: str, annotations: str, video_root: str, split: str, output: str, mapping: str | None = None) -> int:
    """Annotations of a known dataset to a validated manifest of JSON lines; refuses to overwrite. Returns the rows."""
    if dataset == "star":
        rows = read_nested(spark, annotations)
    else:
        rows = read_parquet(spark, annotations) if annotations.endswith(".parquet") else read_csv(spark, annotations)
    manifest = resolved(remapped(ADAPTERS[dataset](rows, split), read_remap(spark, mapping)), video_index(spark, video_root)).cache()
    try:
        require(manifest)
        manifest.write.mode("errorifexists").option("ignoreNullFields", "false").json(output)
        return manifest.count()
    finally:
        manifest.unpersist()
