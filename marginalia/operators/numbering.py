"""Places of rows in an order over the whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import fresh


def numbered(df: DataFrame, *order: Column | str, name: str = "position", path: str | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0.

    The rows are cut into ranges and sorted once, and written with their places in their range (at ``path``, else
    in the shared folder); a range's offset is the sum of the counts before it, one row for each range. Equal
    rows get places of their own, which stay as they are.
    """
    spark, path = df.sparkSession, path or fresh(df.sparkSession, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part, within = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    offsets = offsets.select(F.col("part").alias(f"{name}_part"), F.col("before").alias(f"{name}_before"))
    place = within + F.col(f"{name}_before")
    joined = rows.join(F.broadcast(offsets), part == F.col(f"{name}_part"))  # as many rows as the write had tasks
    return joined.select(*df.columns, place.alias(name))
