"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import discard, materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable over edges (u, v).

    Ids that no edge names are absent. Null ends and loops are ignored; repeated and reversed
    edges count once; without edges the result is empty. Each round is a few joins and
    aggregates, written to the shared scratch folder, and the number of rounds grows with the
    logarithm of the longest path. Hubs are pre-aggregated by min before they shuffle.
    """
    tidy = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").select("u", "v")
    cur = materialise(tidy.distinct(), "cc")
    last = None
    for _ in range(MAX_ROUNDS):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = materialise(large, "cc-large")
        down = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-small")
        sign = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(cur, star)
        cur = nxt
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    out = materialise(cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "cc-out")
    discard(cur)
    return out
