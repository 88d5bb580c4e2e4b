"""The keyed stream of verdicts against the batch merge: order, repeats, restarts, expiry."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracemill.schema import KEY
from tracemill.streaming import verdicts

T0 = dt.datetime(2024, 1, 1)


def events(rng, n=40):
    out = []
    for i in range(n):
        t = rng.randrange(0, 100)
        for seq in range(1, rng.randrange(2, 4)):
            out.append(("d", f"m{i % 3}", i, "sent", seq, None, None, T0 + dt.timedelta(minutes=t)))
            if rng.random() < 0.6:  # answered in time, for better or worse
                bad = rng.random() < 0.4
                out.append(("d", f"m{i % 3}", i, "reply", seq, "parse error" if bad else None, None if bad else rng.randrange(9), T0 + dt.timedelta(minutes=t + rng.randrange(1, 50))))
            t += 70
    return sorted(out, key=lambda r: r[-1])


def run(spark, base, stop_after=None):
    stream = spark.readStream.schema(verdicts.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = verdicts.write_changes(verdicts.verdict_changes(stream), f"{base}/out", f"{base}/check")
    assert q.awaitTermination(150)


def put(spark, base, name, rows):
    spark.createDataFrame(rows, verdicts.EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_batch_over_restarts_and_repeats(spark, tmp_path, seed):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        base, rows = str(tmp_path), events(random.Random(seed))
        third = len(rows) // 3
        put(spark, base, "a", rows[:third])
        run(spark, base)
        put(spark, base, "b", rows[third : 2 * third])
        put(spark, base, "b", rows[third : third + 5])  # the same events once more
        run(spark, base)  # a new query takes up the state of the one before
        put(spark, base, "c", rows[2 * third :])
        end = T0 + dt.timedelta(days=2)
        put(spark, base, "d", [("d", "end", -1, "reply", 1, None, 0, end)])
        run(spark, base)
        run(spark, base)  # nothing new
        whole = spark.createDataFrame([*rows, ("d", "end", -1, "reply", 1, None, 0, end)], verdicts.EVENT)
        last, never = verdicts.as_batch(whole)
        key = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert key(verdicts.current(spark, f"{base}/out")) == key(last.select(*KEY, "batch_seq", "error", "num_backtracking_steps"))
        assert key(verdicts.expired(spark, f"{base}/out")) == key(never) and never.count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
