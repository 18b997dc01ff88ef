"""Data-quality rules, counted in one pass; any violation stops the run, no row is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.selectors import finite
from marginalia.functions.text import safe_path, strip


def _number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def manifest_rules() -> dict[str, Column]:
    """By name, whether a manifest row breaks the rule."""
    c = F.col
    blank = lambda x: x.isNull() | (strip(x) == "")
    holds = {
        "video_path": safe_path(c("video")),
        "id_split": F.coalesce((F.length("id") > 0) & (F.length("split") > 0), F.lit(False)),
        "question": ~blank(c("question")),
        "choices": F.coalesce(F.size("choices").between(2, 5) & F.forall("choices", lambda x: ~blank(x)), F.lit(False)),
        "answer": c("answer").isNull() | ((c("answer") >= 0) & (c("answer") < F.size("choices"))),
        "start": _number(c("start")) & (c("start") >= 0),
        "end": c("end").isNull() | (_number(c("end")) & (c("end") > c("start"))),
        "sha256": F.coalesce(c("video_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    return {name: ~F.coalesce(ok, F.lit(False)) for name, ok in holds.items()}


def violations(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """``rule, violations`` for every rule, from one scan."""
    rules = manifest_rules() if rules is None else rules
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.violations")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require(df: DataFrame) -> DataFrame:
    """``df`` if it is a nonempty manifest without broken rules or repeated ids; raises otherwise."""
    broken = [(r["rule"], r["violations"]) for r in violations(df).where("violations > 0").collect()]
    if broken:
        raise ValueError("broken rules: " + ", ".join(f"{rule} ({n})" for rule, n in broken))
    if twice := duplicates(df, "id").limit(5).collect():
        raise ValueError("repeated ids: " + ", ".join(r["id"] for r in twice))
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def score_rule(scores: Column) -> Column:
    """Whether selector scores are missing or not finite."""
    return ~F.coalesce((F.size(scores) > 0) & finite(scores), F.lit(False))
