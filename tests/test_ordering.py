"""Prompts in prefix order against brute force, over many ranges, and restored."""

import os
import random

from pyspark.sql import functions as F

from tracemill.operators import ordering


def test_reuse_equals_brute_force_and_order_is_restored(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(400)] + [None] * 3 + ["", "ü" * 5000, "ü" * 4000 + "x"]
    rng.shuffle(texts)
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string, `a b` int").repartition(7)
    first = [tuple(r) for r in df.collect()]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.in_prefix_order(df, ["text", "i"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got.sort(key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [r.i for r in got] == [r[0] for r in want] and [r.place for r in got] == list(range(len(rows)))
    shared = [0] + [len(os.path.commonprefix([a[1], b[1]])) if a[1] is not None and b[1] is not None else 0 for a, b in zip(want, want[1:])]
    assert [r.reused for r in got] == shared and sum(shared) > 5000
    back = ordering.restored(ordering.in_prefix_order(df, ["text", "i"]))
    assert [tuple(r) for r in back.collect()] == first and back.columns == ["i", "text", "a b"]
    assert ordering.in_prefix_order(df.where("i < 0"), ["text"]).collect() == []


def test_common_prefix(spark):
    cases = [("", "", 0), ("a", "", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("x", "y", 0), ("𝄞a", "𝄞b", 1), (None, "a", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert {r.i: r.n for r in df.select("i", ordering.common_prefix("a", "b").alias("n")).collect()} == {i: c[2] for i, c in enumerate(cases)}
