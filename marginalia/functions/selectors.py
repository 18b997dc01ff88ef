"""Frame selection as column functions: arrays in, arrays of frame indices out, no Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("int")


def indices(n) -> Column:
    """0 to n - 1; empty for n of 0 or less."""
    n = _int(n)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def finite(scores: Column) -> Column:
    """Whether all elements are present and finite."""
    return F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def uniform(n, k) -> Column:
    """k indices evenly over n, ends included, halves rounded to even; the middle one for k of 1."""
    n, k = _int(n), F.least(_int(n), _int(k))
    step = lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int")
    return F.when(k == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(F.transform(indices(k), step))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_score(scores: Column) -> Column:
    """Indices by score, highest first, of equals the smaller first."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def topk(scores: Column, k) -> Column:
    """The k indices of highest score, in index order."""
    return F.array_sort(F.slice(by_score(scores), 1, _int(k)))


def gap_fill(n, initial: Column, budget) -> Column:
    """Add the index farthest from all chosen ones, of equals the smallest, until ``budget`` are chosen."""
    n, budget = _int(n), F.least(_int(n), _int(budget))

    # the state has each index's distance to the nearest chosen one, 0 for those
    def add(state: Column, _: Column) -> Column:
        def grown(new: Column) -> Column:
            return F.struct(F.concat(state["chosen"], F.array(new)).alias("chosen"), F.transform(state["gap"], lambda g, i: F.least(g, F.abs(i - new))).alias("gap"))

        far = -F.array_max(F.transform(state["gap"], lambda g, i: F.struct(g.alias("gap"), (-i).alias("minus"))))["minus"]
        return F.when(F.size(state["chosen"]) < budget, let(far, grown)).otherwise(state)

    def filled(chosen: Column) -> Column:
        gap = F.transform(indices(n), lambda i: F.coalesce(F.array_min(F.transform(chosen, lambda j: F.abs(i - j))), n))
        return F.aggregate(indices(budget), F.struct(chosen.alias("chosen"), gap.alias("gap")), add, lambda done: F.array_sort(done["chosen"]))

    return let(F.array_distinct(initial.cast("array<int>")), filled)


def evidence(times: Column, initial: Column, budget, question: Column, first: Column, second: Column, neighbor_seconds, weight) -> Column:
    """Frames that tell two options apart, as ``struct(ids, anchors)``.

    A frame scores the difference of the two options' relevance plus ``weight`` times the question's. Turns
    alternate between frames that favour the first option (or neither) and the second; each takes the best
    frame left of its side, or of both, then the earliest frame up to ``neighbor_seconds`` before it and the
    latest up to that after it, while there is room.
    """
    none = F.array().cast("array<int>")
    near, weight = F.lit(neighbor_seconds).cast("double"), F.lit(weight).cast("double")
    rows = F.transform(F.arrays_zip(first.alias("a"), second.alias("b"), question.alias("q")), lambda r: F.struct((F.abs(r["a"] - r["b"]) + weight * r["q"]).alias("s"), (r["a"] >= r["b"]).alias("side")))

    def fold(bound: Column) -> Column:
        t, ranked, side, n, room = (bound[c] for c in ("t", "ranked", "side", "n", "room"))

        def turn(state: Column, step: Column) -> Column:
            ids, anchors = state["ids"], state["anchors"]

            def grown(left: Column) -> Column:
                favours = F.filter(left, lambda i: F.get(side, i) == (step % 2 == 0))
                return let(F.coalesce(F.get(favours, F.lit(0)), F.get(left, F.lit(0))), around)

            def around(anchor: Column) -> Column:
                at = F.get(t, anchor)
                before = F.array_min(F.filter(indices(anchor), lambda i: at - F.get(t, i) <= near))
                after = F.array_max(F.filter(indices(n), lambda i: (i > anchor) & (F.get(t, i) - at <= near)))
                new = F.array_except(F.filter(F.array(anchor, before, after), lambda i: i.isNotNull()), ids)
                more = F.concat(ids, F.slice(new, 1, F.greatest(room - F.size(ids), F.lit(0))))
                return F.struct(more.alias("ids"), F.concat(anchors, F.array(anchor)).alias("anchors"))

            same = F.struct(ids.alias("ids"), anchors.alias("anchors"))
            return F.when(F.size(ids) < room, let(F.array_except(ranked, ids), grown)).otherwise(same)

        start = F.struct(F.array_distinct(initial.cast("array<int>")).alias("ids"), none.alias("anchors"))
        return let(F.aggregate(indices(room), start, turn), lambda done: F.struct(F.array_sort(done["ids"]).alias("ids"), done["anchors"].alias("anchors")))

    def prepared(r: Column) -> Column:
        n = F.size(times)
        parts = {"t": times, "ranked": by_score(F.transform(r, lambda x: x["s"])), "side": F.transform(r, lambda x: x["side"]), "n": n, "room": F.least(n, _int(budget))}
        return let(F.struct(*[v.alias(k) for k, v in parts.items()]), fold)

    return let(rows, prepared)


def min_max(scores: Column) -> Column:
    """Scores scaled to [0, 1]."""
    low, high = F.array_min(scores), F.array_max(scores)
    return F.transform(scores, lambda x: (x - low) / (high - low))


def _level(scores: Column, k, t1, t2, parts: Column, depth: Column) -> Column:
    """Split every part once, unless its top scores stand out enough already, or it is split no further."""

    def split(p: Column) -> Column:
        return let(F.slice(scores, p["lo"] + 1, p["hi"] - p["lo"]), lambda part: halved(p, part))

    def halved(p: Column, part: Column) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        quota = F.greatest(F.lit(1), F.floor(F.lit(k) / F.pow(F.lit(2.0), p["depth"])).cast("int"))
        top = F.slice(F.sort_array(part, False), 1, quota)
        lead = total(top) / F.least(quota, F.size(part)) - total(part) / F.size(part)
        spread = let(total(part) / F.size(part), lambda m: F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(part)))
        stays = ((lead > F.lit(t1)) & (spread > F.lit(t2))) | (p["depth"] < depth) | (p["hi"] - p["lo"] < 2)
        middle = F.floor((p["lo"] + p["hi"]) / 2).cast("int")
        half = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), (p["depth"] + 1).alias("depth"))
        return F.when(stays, F.array(F.struct(*[p[c].alias(c) for c in ("lo", "hi", "depth")]))).otherwise(F.array(half(p["lo"], middle), half(middle, p["hi"])))

    return F.flatten(F.transform(parts, split))


def segment_quota(scores: Column, k, t1: float = 0.8, t2: float = -100.0, depth: int = 5, splitter: Callable[[Column, Column], Column] | None = None) -> Column:
    """Top frames of adaptive segments, as ``struct(ids, status)``.

    The splitter is this engine's own: a segment of min-max scores is halved, to at most ``depth`` levels (and
    the whole part of log2 n), unless its quota's mean stands more than ``t1`` above its own mean and its
    deviation above ``t2``. Another ``splitter`` takes the scaled scores and the number of levels, and returns an
    array of ``struct(lo, hi, depth)``. A segment at level d gives its best ``floor(k / 2^d)`` frames. Short or constant
    scores, and quotas of no frame at all, fall back to uniform.
    """
    n = F.size(scores)
    deepest = F.least(F.lit(depth), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-9).cast("int"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), n.alias("hi"), F.lit(0).alias("depth")))

    def best(scaled: Column, p: Column) -> Column:
        quota = F.floor(F.lit(k) / F.pow(F.lit(2.0), p["depth"])).cast("int")
        return F.transform(F.slice(by_score(F.slice(scaled, p["lo"] + 1, p["hi"] - p["lo"])), 1, quota), lambda i: i + p["lo"])

    def chosen(scaled: Column) -> Column:
        parts = splitter(scaled, deepest) if splitter else F.aggregate(indices(deepest), whole, lambda parts, d: _level(scaled, k, t1, t2, parts, d))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: best(scaled, p)))))

    flat = (n <= _int(k)) | (F.array_max(scores) == F.array_min(scores))
    reply = lambda ids, status: F.struct(ids.alias("ids"), status.alias("status"))
    named = F.when(deepest != depth, F.lit("depth_capped_short_clip")).otherwise(F.lit("upstream"))
    split = let(let(min_max(scores), chosen), lambda ids: F.when(F.size(ids) == 0, reply(uniform(n, k), F.lit("zero_quota_uniform"))).otherwise(reply(ids, named)))
    return F.when(flat, reply(uniform(n, k), F.lit("short_or_constant_uniform"))).otherwise(split)
