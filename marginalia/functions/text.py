"""Text, path and digest functions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"(?U)^\s+|\s+$"
VIDEO_EXTENSIONS = ("mp4", "avi", "mkv", "webm")


def strip(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, _SPACE, "")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_path(path: Column) -> Column:
    """A nonempty relative path without parents or drive letters."""
    p = slashed(path)
    return F.coalesce((F.length(p) > 0) & ~F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit(":")) & ~F.array_contains(F.split(p, "/"), ".."), F.lit(False))


def stem(path: Column) -> Column:
    """A file's name without folders and last extension."""
    return F.regexp_replace(F.substring_index(slashed(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def json_text(x: Column) -> Column:
    """A string as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for i in range(32):
        full = F.replace(full, F.lit(chr(i)), F.lit(json.dumps(chr(i))[1:-1]))
    return F.concat(F.lit('"'), F.when(F.rlike(x, F.lit("[\\x00-\\x1f]")), full).otherwise(plain), F.lit('"'))


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """A value as JSON text with sorted keys: structs, maps, arrays, strings, whole numbers, truth values and nulls.

    Numbers with a point are refused: their shortest text differs between engines.
    """
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), canonical_json(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys must be strings")
        one = lambda e: F.concat(json_text(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x)), one), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical_json(e, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = json_text(x)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = x.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON text here")
    return F.coalesce(text, F.lit("null"))


def subset_key(id: Column, seed: int) -> Column:
    """Order key of the deterministic subset: SHA-256 of the JSON pair of seed and id."""
    return F.sha2(F.concat(F.lit(f"[{seed}, "), json_text(id), F.lit("]")).cast("binary"), 256)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the JSON list of sorted ids."""
    listed = F.array_join(F.transform(F.array_sort(ids), json_text), ", ")
    return F.sha2(F.concat(F.lit("["), listed, F.lit("]")).cast("binary"), 256)


def three_decimals(x: Column) -> Column:
    """A number with three decimals, rounded by its exact binary value, halves to even.

    A double under 2^53 is its 53 bits m over a power of two, 2^s; a thousand m fits a long, so shifts and
    comparisons of longs give the thousandths exactly. Numbers of 2^63 and more are refused.
    """
    size = F.abs(x.cast("double"))
    guess = F.floor(F.log2(size)).cast("int")
    power = lambda k: F.pow(F.lit(2.0), k)
    k = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    shift = F.greatest(F.lit(1), F.least(F.lit(63), 52 - k))
    parts = F.struct(shift.alias("s"), (size * power(shift)).cast("long").alias("m"))

    def rounded(p: Column) -> Column:
        n, s = p["m"] * 1000, p["s"]
        down = F.call_function("shiftright", n, s)
        rest, half = n - F.call_function("shiftleft", down, s), F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)
        return down + ((rest > half) | ((rest == half) & (down % 2 == 1))).cast("long")

    one = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    text = lambda whole, part: F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 3, "0"))
    under = one(one(parts, rounded), lambda n: text(F.floor(n / 1000).cast("long"), n % 1000))
    plain = F.when(size < 2.0**-12, "0.000").when(size < 2.0**52, under).when(size < 2.0**63, text(size.cast("long"), F.lit(0))).otherwise(F.raise_error(F.lit("too large for three decimals")))
    sign = F.when(F.startswith(x.cast("double").cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(x.isNotNull(), F.concat(sign, plain))
