"""Metrics over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.answers import argmax


def labelled(df: DataFrame) -> DataFrame:
    return df.where("answer is not null")


def rate(x: Column) -> Column:
    """Share of true among the non-null; null if there are none."""
    return F.avg(x.cast("int"))


#: Of a group with more values only those about a rank are ranked; approximate percentiles, right to one in so many, tell which.
RANKED = 10_000


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """Values at index ``round((n - 1) * fraction)`` (halves to even) of each group's sorted values.

    No interpolation. Approximate percentiles, two steps of their precision apart on either side, bound each
    value; values below are counted, and those between are counted by value and ranked, so a task sees a few
    ten-thousandths of a large group.
    """
    some = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    edges = [F.struct(*[F.when(F.count("v") > RANKED, F.percentile_approx("v", F.lit(min(1.0, max(0.0, f + 2 * side / RANKED))), F.lit(RANKED))).otherwise(end("v")).alias(name) for side, end, name in ((-1, F.min, "low"), (1, F.max, "high"))]) for f in fractions.values()]
    bounds = some.groupBy(*by).agg(F.count("v").alias("n"), F.array(*edges).alias("edges"))
    beside = some.join(bounds, list(by)) if by else some.join(F.broadcast(bounds))
    k, edge = F.col("k"), F.get("edges", F.col("k"))
    near = beside.select(*by, "v", "n", "edges", F.explode(F.sequence(F.lit(0), F.lit(len(fractions) - 1))).alias("k")).where(F.col("v") <= edge["high"])
    counts = near.groupBy(*by, "k", "n", F.when(F.col("v") >= edge["low"], F.col("v")).alias("v")).agg(F.count("*").alias("c"))  # a null value: all below
    upto = F.sum("c").over(Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first()))
    wanted = F.bround((F.col("n") - 1) * F.get(F.array(*[F.lit(f) for f in fractions.values()]), k))
    found = counts.withColumn("upto", upto).where(F.col("upto") > wanted).groupBy(*by, "k").agg(F.min("v").alias("v"))
    picks = [F.max(F.when(k == i, F.col("v"))).alias(name) for i, name in enumerate(fractions)]
    return found.groupBy(*by).agg(*picks)


def percentiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """``nearest_rank`` over a whole table."""
    return nearest_rank(df, value, fractions)


def accuracy(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("completed_count"), F.count("answer").alias("labelled_completed"), rate(F.when(F.col("answer").isNotNull(), F.col("correct"))).alias("accuracy_completed"))


def accuracy_by(results: DataFrame, key: Column) -> DataFrame:
    return labelled(results).groupBy(key).agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"))


def accuracy_by_type(results: DataFrame) -> DataFrame:
    return accuracy_by(results, F.col("question_type"))


def accuracy_macro(results: DataFrame) -> DataFrame:
    """Unweighted mean of the types' accuracies."""
    return accuracy_by_type(results).agg(F.avg("accuracy").alias("macro_type_accuracy"))


def accuracy_by_letter(results: DataFrame, dataset: str = "nextqa") -> DataFrame:
    """By the first letter of the type, in one dataset."""
    return accuracy_by(results.where(F.col("dataset") == dataset), F.upper(F.substring("question_type", 1, 1)).alias("letter"))


def flips(results: DataFrame) -> DataFrame:
    """How often the last answer is right where the first was wrong, and the other way round."""
    first = argmax(F.get(F.col("calls"), F.lit(0))["scores"]) == F.col("answer")
    return labelled(results).agg(F.count_if(~first & F.col("correct")).alias("wrong_to_right"), F.count_if(first & ~F.col("correct")).alias("right_to_wrong"))


def costs(results: DataFrame) -> DataFrame:
    return results.agg(
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg(F.size("calls")).alias("mean_vlm_calls"),
        F.avg("frame_presentations").alias("mean_frame_presentations"),
        F.avg("final_frames").alias("mean_final_frames"),
        rate(F.col("refined")).alias("refinement_rate"),
    )


def latency(results: DataFrame) -> DataFrame:
    sums = results.agg(F.avg("elapsed_seconds").alias("latency_mean_seconds"), F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)).alias("measured_question_seconds"), F.max("peak_vram_allocated_gib").alias("peak_vram_allocated_gib"))
    return sums.join(percentiles(results, "elapsed_seconds", {"latency_p50_seconds": 0.5, "latency_p95_seconds": 0.95}))


def nodes(results: DataFrame) -> DataFrame:
    return results.where("execution.node is not null").select(F.col("execution.node").alias("node")).distinct()


def summary(results: DataFrame, contract: dict) -> dict:
    """The run's summary; every part is aggregated by Spark, the driver gets single rows and one row per type."""
    row = lambda df: df.first().asDict()
    table = lambda df, key: {r[key]: {"n": r["n"], "accuracy": r["accuracy"]} for r in df.orderBy(key).collect()}
    counts = row(accuracy(results))
    return {
        "synthetic": contract["config"]["backend"] == "mock",
        "resolved_dtype": contract.get("resolved_dtype"),
        "nodes": sorted(r["node"] for r in nodes(results).collect()),
        "complete": counts["completed_count"] == contract["selected_count"],
        "selected_count": contract["selected_count"],
        **counts,
        "per_type": table(accuracy_by_type(results), "question_type"),
        **row(accuracy_macro(results)),
        "nextqa_CTD": table(accuracy_by_letter(results), "letter"),
        **row(latency(results)),
        **row(costs(results)),
        "answer_changes": row(flips(results)),
        "timing_scope": "a whole micro-batch: selection and all answer calls; excludes model load",
    }
