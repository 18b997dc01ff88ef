"""Places in an order, over many partitions."""

import random

from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered


def test_numbered(spark, frame):
    gen = random.Random(3)
    rows = [(gen.choice([None, *"abcdé\U0001f600"]), gen.randrange(40), i) for i in range(3000)]
    df = frame(rows, "k string, v int, i int", 7)
    got = numbered(df, F.col("k").asc_nulls_last(), F.desc("v"), name="n").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode(), -r[1]))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.n)] == [r[:2] for r in want]
    assert sorted(r.n for r in got) == list(range(3000)) and sorted(r.i for r in got) == list(range(3000))
    assert numbered(df.limit(0), "k").count() == 0
