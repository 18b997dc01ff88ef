"""License scans: segments of normalised text compared to templates by the Dice coefficient over word bigrams.

DataFrame functions only. Text is lower-cased, all but letters and digits separates words. A segment and a
template with a and b distinct bigrams can only have a Dice coefficient of t if a/b lies between t/(2-t) and
(2-t)/t, and has at least b t/(2-t) of the template's bigrams. So a text is dropped if it holds too few
bigrams of each template, and templates out of those bounds are pruned before any segment is compared. The
templates are a literal of fixed size, so nothing is joined or shuffled.

Segments are the text's lines, and, for notices wrapped over lines or inside a line, windows of the whole text's
words. ``sql`` gives the lines only.

Defined cases: a null or empty text has no notices; a null id stays null; repeated rows are scanned each;
a segment that fits several templates gets the best, of equals the first by name; a very long text costs about
twenty times its bytes while its words are an array; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Notices by licence, as their licences ask or projects write them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def _bigrams(text: str) -> list[str]:
    w = _plain(text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def known(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """Templates of two words or more: name, distinct bigrams, and the bounds of a line's bigrams."""
    t = Fraction(str(threshold))
    out = [(name, _bigrams(text)) for name, text in templates]
    return [(name, g, max(1, math.ceil(len(g) * t / (2 - t))), math.floor(len(g) * (2 - t) / t)) for name, g in out if g]


def _words(text: Column) -> Column:
    """Words of lower-cased text."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _dice(grams: Column, t: Column) -> Column:
    """The Dice coefficient of distinct bigrams with a template's; null out of its bounds."""
    return F.when(F.size(grams).between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"])))


def _pairs_of(w: Column) -> Column:
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``id_col, line, license, dice`` for every line that matches a template, and every window of words beside, with the line it begins in; lines count from 0.

    A window begins and ends with a bigram of its template (others at its ends only lower the coefficient),
    and has at most twice as many bigrams as distinct ones may be there. Of windows that overlap the best
    stays, of equals that of the first template, then the first, then the shortest; none stays that overlaps
    a line that matches as well or for the same licence.
    """
    kept = known(templates, threshold)
    every = sorted({g for x in kept for g in x[1]})
    known_ones = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("license"), F.array(*[F.lit(g) for g in grams]).alias("grams"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (name, grams, low, high) in enumerate(kept)])
    least = min(x[2] for x in kept)
    some = docs.select(F.col(id_col), _once(F.lower(F.col(text_col).cast("string"))).alias("t"))
    words = F.split(F.trim(F.regexp_replace("t", r"[^\p{L}\p{N}]+", " ")), " ")
    some = some.select(id_col, "t", _once(words).alias("w")).where(F.size("w") > least)
    some = some.select(id_col, "t", _once(F.array_intersect(_pairs_of(F.col("w")), F.array(*[F.lit(g) for g in every]))).alias("seen")).where(F.size("seen") >= least)
    asked = F.filter(known_ones, lambda t: F.size(F.array_intersect("seen", t["grams"])) >= t["low"])
    some = some.select(id_col, "t", _once(asked).alias("asked")).where(F.size("asked") > 0)
    some = some.select(id_col, "asked", _once(F.transform(F.split("t", "\n"), _words)).alias("lines"))
    some = some.select(id_col, "asked", "lines", _once(_pairs_of(F.flatten("lines"))).alias("g"))
    hits = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.get("g", i).isin(every))
    some = some.select(id_col, "asked", "lines", "g", _once(hits).alias("hits"))

    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of_template(t: Column) -> Column:
        at = F.filter("hits", lambda i: F.array_contains(t["grams"], F.get("g", i)))
        return bound(at, lambda at: bound(F.transform(at, lambda i: F.array_position(t["grams"], F.get("g", i))), lambda which: bound(placed(t, at, which), lambda hits: windows(t, hits))))

    def placed(t: Column, at: Column, which: Column) -> Column:
        """Each hit's place, and the number of the last hit before it, among as many as a window may hold, of the same bigram."""
        some = lambda k: F.least(k, 2 * t["high"])
        back = lambda i, k: F.array_position(F.reverse(F.slice(which, k - some(k) + 1, some(k))), F.get(which, k)).cast("int")
        return F.transform(at, lambda i, k: bound(back(i, k), lambda p: F.struct(i.alias("at"), F.when(p > 0, k - p).otherwise(-1).alias("last"))))

    def windows(t: Column, hits: Column) -> Column:
        """Windows that fit. One that ends with a bigram it holds already is never better than a shorter one."""
        window = lambda i, j: F.named_struct(F.lit("less"), -_dice(F.array_distinct(F.slice("g", i + 1, j - i + 1)), t), F.lit("place"), t["place"], F.lit("start"), i, F.lit("end"), j, F.lit("license"), t["license"])
        # a window that fits has as many hits as distinct bigrams at least: only some of the next can end it
        ends = lambda h, k: F.filter(F.slice(hits, k + t["low"], 2 * t["high"]), lambda x: (x["at"] >= h["at"] + t["low"] - 1) & (x["at"] < h["at"] + 2 * t["high"]) & (x["last"] < k))
        return F.flatten(F.transform(hits, lambda h, k: F.filter(F.transform(ends(h, k), lambda x: window(h["at"], x["at"])), lambda x: x["less"] <= -threshold)))

    some = some.select(id_col, "asked", "lines", _once(F.array_sort(F.flatten(F.transform("asked", of_template)))).alias("found"))
    # what fits a line fits the text, so only the templates asked for can
    fit = lambda w: F.array_max(F.transform("asked", lambda t: F.named_struct(F.lit("dice"), _dice(F.array_distinct(_pairs_of(w)), t), F.lit("later"), -t["place"], F.lit("license"), t["license"])))
    some = some.select(id_col, "found", _once(F.transform("lines", fit)).alias("fits"), _once(F.flatten(F.transform("lines", lambda w, k: F.array_repeat(k, F.size(w))))).alias("line_of"))

    def free(x: Column) -> Column:
        first, last = F.get("line_of", x["start"]), F.get("line_of", x["end"] + 1)
        return ~F.exists(F.slice("fits", first + 1, last - first + 1), lambda f: F.coalesce((f["dice"] >= threshold) & ((f["dice"] >= -x["less"]) | (f["license"] == x["license"])), F.lit(False)))

    some = some.select(id_col, "fits", "line_of", _once(F.filter("found", free)).alias("found"))
    apart = F.aggregate("found", F.slice("found", 1, 0), lambda out, x: F.when(F.exists(out, lambda y: (y["start"] <= x["end"] + 1) & (x["start"] <= y["end"] + 1)), out).otherwise(F.concat(out, F.array(x))))
    row = lambda line, license, dice: F.struct(line.cast("long").alias("line"), license.alias("license"), F.round(dice, 6).alias("dice"))
    whole = F.filter(F.transform("fits", lambda f, k: row(k, f["license"], F.when(f["dice"] >= threshold, f["dice"]))), lambda x: x["dice"].isNotNull())
    beside = F.transform(apart, lambda x: row(F.get("line_of", x["start"]), x["license"], -x["less"]))
    return some.select(id_col, F.explode(F.concat(whole, beside)).alias("one")).select(id_col, "one.line", "one.license", "one.dice")


def _once(value: Column) -> Column:
    """A value as the only element of an exploded array: filters above use it instead of computing it again."""
    return F.explode(F.array(value))


def sql(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """The same result over the view ``documents``, in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in grams)}])" for i, (name, grams, _, _) in enumerate(known(templates, threshold)))
    return rf"""
        WITH t(place, license, g) AS (VALUES {rows}),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
        words AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines),
        grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
        fits AS (SELECT doc_id, line, license, place, 2.0::DOUBLE * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) AS dice FROM grams, t
                 WHERE {threshold} * (len(grams.g) + len(t.g)) <= 2 * least(len(grams.g), len(t.g)))
        SELECT doc_id, line, license, round(dice, 6) AS dice FROM fits WHERE dice >= {threshold}
        QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, place) = 1
    """
