"""Manifests of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.rules import require
from marginalia.schema import MANIFEST, PUBLIC


def read(spark: SparkSession, path: str) -> DataFrame:
    """A validated manifest. Unknown fields, missing fields without a default, and malformed lines raise."""
    found = set(spark.read.json(path).columns)
    if unknown := found - set(MANIFEST.names):
        raise ValueError(f"unknown or malformed fields: {', '.join(sorted(unknown))}")
    if missing := set(MANIFEST.names) - found - {"start", "end", "answer"}:
        raise ValueError(f"missing fields: {', '.join(sorted(missing))}")
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    return require(rows.withColumn("start", F.coalesce("start", F.lit(0.0))))


def public(manifest: DataFrame) -> DataFrame:
    """What inference may see of a manifest."""
    return manifest.select(*PUBLIC)
