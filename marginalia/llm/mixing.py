"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Of all rates of documents that meet the targets, with at most ``most``
copies of any, the one closest to one copy each in relative entropy is ``min(most, exp(lambda * size))``, with one
dual variable a source. Newton iterations, kept inside a bracket, solve the convex dual for all sources at
once; what they sum over is the exact histogram of sizes by source. Rates become copies by a hash of the
document: its k-th copy comes at the place ``k - rate - hash`` of its source, and copies are taken in order of
places up to the target. The place at which a target is reached is found digit by digit, from sums by digit, so
documents are never sorted or shuffled; the copy that stands there is taken in part.

Defined cases: a null text has no words and a null source is a source of its own, the last; a document without
words is never taken; documents without an id are mixed like others; repeated rows of one id and text stand
at one place and are taken alike (where it is the last place, each takes an equal part); reruns agree, in any
order of rows and at any partitioning; an empty table gives no rows; long texts are counted in the JVM
without being split; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import written
from marginalia.operators.numbering import numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton steps at most (rounding meets what they leave), and the part of a target within which a source is done.
STEPS, CLOSE = 60, 1e-9
BITS, DIGIT = 48, 12
_SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """How many runs of other than white space a text has; null has none."""
    marks = F.regexp_replace(text, rf"{_SPACE}*+[^\x20\x09-\x0D]++{_SPACE}*+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``number, source, source_size, target`` of each source of ``rows(source, size)``, in order of code points, null last.

    The sources share ``share`` of all sizes by weights that repeat. None is given more than ``most`` times its
    size; what is left over is shared anew among the others, until none is above: a common level of target by weight,
    found in rounds of two sums each.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = numbered(sizes, F.col("source").asc_nulls_last(), name="number").withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    known = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    whole, held = share * (known["all"] or 0), -1
    level = whole / known["weight"] if known["weight"] else 0.0
    while True:
        above = F.col("cap") <= F.col("weight") * level
        got = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if got["n"] == held or not got["weight"]:
            break
        held, level = got["n"], (whole - (got["cap"] or 0)) / got["weight"]
    return sources.select("number", "source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def balance(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with ``tilt``, the dual variable, for ``counts(number, size, n)``, how many documents have a size.

    It is null where rates are at their ends: none of a source, or ``most`` copies of all of it.
    """
    c = F.col
    sure = (c("target") <= 0) | (c("target") >= most * c("source_size"))
    first = F.log(c("target") / c("source_size"))  # sizes are 1 or more: there all rates are small enough, and at log(most) all are capped
    state = sources.where(~sure).select("number", "target", F.least(first, F.lit(0.0)).alias("low"), F.when(first > 0, math.log(most)).otherwise(0.0).alias("high"))
    counts = written(counts.join(state.select("number"), "number"), "counts")
    mean = counts.groupBy("number").agg((F.sum(c("n") * c("size").cast("double") * c("size")) / F.sum(c("n") * c("size"))).alias("mean"))
    ratio = F.log(c("target") / c("source_size"))
    state = written(state.join(mean, "number").join(sources.select("number", "source_size"), "number").withColumn("tilt", ratio / F.col("mean")).select("number", "target", "low", "high", "tilt").withColumn("close", F.lit(False)), "tilts")
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")  # noqa: E731 a sum that has no order
    for _ in range(STEPS):
        rate = F.exp(c("tilt") * c("size"))
        mass = c("n") * c("size") * F.least(rate, F.lit(float(most)))
        slope = F.when(rate < most, c("n") * c("size") * c("size") * rate).otherwise(0.0)
        sums = counts.join(state.where("not close").select("number", "tilt"), "number").groupBy("number").agg(exact(mass).alias("mass"), exact(slope).alias("slope"))
        new = state.join(sums, "number", "left")
        low, high = F.when(c("mass") < c("target"), c("tilt")).otherwise(c("low")), F.when(c("mass") > c("target"), c("tilt")).otherwise(c("high"))
        near = F.abs(c("mass") - c("target")) <= CLOSE * c("target")
        step = c("tilt") + F.log(c("target") / c("mass")) * c("mass") / c("slope")
        new = new.select("number", "target", low.alias("low"), high.alias("high"), "tilt", step.alias("step"), (c("close") | near).alias("close"))
        inside = F.coalesce((c("step") > c("low")) & (c("step") < c("high")), F.lit(False))
        new = new.select("number", "target", "low", "high", F.when(c("close"), c("tilt")).when(inside, c("step")).otherwise((c("low") + c("high")) / 2).alias("tilt"), "close")
        state = written(new, "tilts")
        if not state.where("not close").count():
            break
    return sources.join(state.select("number", "tilt"), "number", "left")


def _rate(most: int) -> Column:
    tilted = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size")))
    return F.when(F.col("tilt").isNotNull(), tilted).when(F.col("target") > 0, float(most)).otherwise(0.0)


def _places(most: int) -> Column:
    """The places of a document's copies, as whole numbers under 2^BITS."""
    part = F.col("hash").bitwiseAND(F.lit((1 << 46) - 1)).cast("double") / float(1 << 46)
    scaled = lambda k: ((F.lit(float(k)) - _rate(most) - part + most) / (2.0 * most) * float(1 << BITS)).cast("long")
    return F.array(*[F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << BITS) - 1), scaled(k))) for k in range(1, most + 1)])


def ends(rows: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with ``end``, the place at which the target is reached, and ``part``, what each copy there gives."""
    c = F.col
    goal = F.floor(c("target") + 0.5).cast("long")
    state = written(sources.select("number", F.lit(0).cast("long").alias("end"), goal.alias("rest"), F.lit(1).cast("long").alias("n"), (goal < most * c("source_size")).alias("open")), "ends")
    copies = rows.where("size > 0").select("number", "size", F.explode(_places(most)).alias("place"))
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        asked = state.where("open").select("number", "end", "rest")
        within = copies.join(asked, "number").where(F.shiftright("place", shift + DIGIT) == c("end"))
        digits = within.groupBy("number", "end", "rest", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        upto = F.sum("size").over(Window.partitionBy("number").orderBy("digit"))  # 2^DIGIT rows a source at most
        over = digits.withColumn("upto", upto).where("upto > rest").groupBy("number").agg(F.min_by(F.struct(c("digit"), (c("rest") - c("upto") + c("size")).alias("rest"), "n"), "digit").alias("x"))
        new = state.join(over, "number", "left")
        state = written(new.select("number", F.coalesce("x.digit", "end").alias("end"), F.coalesce("x.rest", "rest").alias("rest"), F.coalesce("x.n", "n").alias("n"), "open"), "ends")
    last = state.select("number", F.when(c("open"), c("end")).otherwise(1 << BITS).alias("end"), F.when(c("open"), F.floor(c("rest") / c("n"))).otherwise(0).cast("long").alias("part"))
    return written(sources.join(last, "number"), "sources")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``id, source, size, hash`` of all documents, and the sources: ``source, source_size, target, tilt, end, part``."""
    rows = written(_rows(docs, id_col, text_col, source_col), "sizes")
    sources = written(targets(rows, weights, share, most), "targets")
    counts = _met(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), sources.select("number", "source")).select("number", "size", "n")
    tilted = written(balance(counts, sources, most), "tilted")
    return rows, ends(_met(rows, tilted).select("number", "size", "hash", "target", "tilt"), tilted, most)


def _met(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns; a small table of sources is broadcast by its size, and a large join's hot source split by Spark."""
    return rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _taken(most: int) -> tuple[Column, Column]:
    """Whole copies of a document, and the words of one more that is taken in part."""
    places = _places(most)
    copies = F.aggregate(places, F.lit(0), lambda n, p: n + (p < F.col("end")).cast("int"))
    parts = F.aggregate(places, F.lit(0).cast("long"), lambda n, p: n + F.when(p == F.col("end"), F.least("part", "size")).otherwise(0))
    some = F.col("size") > 0
    return F.when(some, copies).otherwise(0), F.when(some, parts).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, source_size, target, rate, copies, part, taken`` of every document (``part``: words of a copy taken in part)."""
    rows, sources = plan(docs, weights, share, most, id_col, text_col, source_col)
    copies, part = _taken(most)
    met = _met(rows, sources).select("id", "source", "size", "source_size", "target", _rate(most).alias("rate"), copies.alias("copies"), part.alias("words"))
    return met.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", F.col("words").alias("part"), (F.col("copies") * F.col("size") + F.col("words")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken; a copy taken in part has its first words only."""
    _, sources = plan(docs, weights, share, most, id_col, text_col, source_col)
    text = F.col(f"row.{text_col}")
    met = _met(docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash")), sources)
    copies, part = _taken(most)
    first = lambda n: F.array_join(F.slice(F.split(F.regexp_replace(text, rf"^{_SPACE}+", ""), rf"{_SPACE}+"), 1, n.cast("int")), " ")
    met = met.select("row", copies.alias("copies"), part.alias("part"))
    texts = F.concat(F.array_repeat(text, F.col("copies")), F.when(F.col("part") > 0, F.array(first(F.col("part")))).otherwise(F.array().cast("array<string>")))
    return met.select("row", F.explode(texts).alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns])
