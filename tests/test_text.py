"""Canonical JSON text and digests against Python's own."""

import hashlib
import json

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import subset


def dumped(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False)


def test_json_text(spark):
    """All code points under U+0100, alone and between others, and literal escapes."""
    values = [chr(i) for i in range(256)] + ["".join(map(chr, range(256))), "", '\\u001F \\" \\\\ \\n', "日本\U0001f600 ", "\x1f\\\x1f"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.json_text(F.col("v")).alias("j")).collect()
    assert [r.j for r in got] == [dumped(v) for v in values]


def test_canonical_json(spark):
    kind = "b int, a array<string>, m map<string,struct<z:boolean,y:bigint>>, `é\"` string"
    rows = [(1, ["x\x01", None], {"k": (True, 2), "j": (None, -5), "é": None}, "q"), (None, [], {}, None), (-3, None, None, '"')]
    df = spark.createDataFrame(rows, kind)
    plain = lambda r: {k: ({n: v and v.asDict() for n, v in x.items()} if isinstance(x, dict) else x) for k, x in r.asDict().items()}
    got = df.select(text.canonical_json(F.struct(*[f"`{c}`" for c in df.columns]), df.schema).alias("j")).collect()
    assert [r.j for r in got] == [dumped(plain(r)) for r in df.collect()]


def test_subset_digest(spark, frame):
    ids = [f"q{i * 7919 % 5000}\x02\"é\U0001f600"[: 3 + i % 9] for i in range(5000)]
    df = frame([(i,) for i in [*ids, None]], "id string", 9)
    got = subset.subset_digest(df).first()
    assert (got.ids_sha256, got.n) == (hashlib.sha256(dumped(sorted(ids)).encode()).hexdigest(), 5001)
    assert got == subset.subset_digest(df.repartition(3)).first()
    assert tuple(subset.subset_digest(df.limit(0)).first()) == (hashlib.sha256(b"[]").hexdigest(), 0)
    assert subset.subset_digest(df.where("id is null")).first().ids_sha256 == hashlib.sha256(b"[]").hexdigest()


def test_three_decimals(spark):
    """Against Python's own rounding: ties, neighbours of ties, all magnitudes, signs."""
    import math
    import random

    gen = random.Random(4)
    values = [0.0625, 0.1875, 0.0005, 0.0015, 2.5, 0.0, -0.0, 1e-9, -1e-9, 5e-324, 2.0**52, 2.0**53 - 1, 2.0**62, -2.5e-4, float("nan"), float("inf"), float("-inf"), 0.9995, 0.99949999, 2.0**-12, 2.0**-11]
    values += [(2 * gen.randrange(10**7) + 1) / 16 for _ in range(20_000)]  # ties
    values += [gen.random() * 10.0 ** gen.randint(-6, 12) for _ in range(60_000)]
    values += [math.nextafter((2 * gen.randrange(10**5) + 1) / 16, gen.choice([0.0, 1e9])) for _ in range(10_000)]
    values += [-round(gen.random() * 100, 4) for _ in range(10_000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.three_decimals(F.col("v")).alias("s")).collect()
    assert len(got) > 100_000 and [r.s for r in got] == [f"{v:.3f}" for v in values]


def test_file_digests(spark, tmp_path):
    from marginalia.sources import files

    (tmp_path / "root/a b").mkdir(parents=True)
    (tmp_path / "root/a b/x.mp4").write_bytes(b"x" * 5000)
    (tmp_path / "root/y.bin").write_bytes(b"y" * 100)
    (tmp_path / "root/none").write_bytes(b"")
    (tmp_path / "outside.mp4").write_bytes(b"z")
    want = {n: hashlib.sha256((tmp_path / "root" / n).read_bytes()).hexdigest() for n in ("a b/x.mp4", "y.bin")}
    for whole in (None, 1000, 1):  # by Spark, some and most as they stream by
        assert {r.file: r.sha256 for r in files.digests(spark, str(tmp_path / "root"), whole).collect()} == want
    found = files.digests(spark, str(tmp_path / "root"))
    rows = spark.createDataFrame([(1, "a b/x.mp4")], "id long, video string")
    assert files.resolved(rows, found).first().file_sha256 == want["a b/x.mp4"]
    import pytest

    for bad in ("../outside.mp4", "gone.mp4", "/y.bin"):
        with pytest.raises(Exception, match="missing or outside"):
            files.resolved(rows.withColumn("video", F.lit(bad)), found).collect()
    (tmp_path / "root/link.mp4").symlink_to(tmp_path / "outside.mp4")
    with pytest.raises(Exception, match="link leads out"):
        files.digests(spark, str(tmp_path / "root")).collect()
    given = {r.file: r.sha256 for r in files.digests(spark, "/root/testdata/sf0.001", 20_000).collect()}
    from pathlib import Path

    assert given == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path("/root/testdata/sf0.001").glob("*.parquet")}
