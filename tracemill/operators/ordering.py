"""An order of prompts in which neighbours share their beginnings, how much they share, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.functions.text import let
from tracemill.sources.scratch import written

_PART, _WITHIN = 33, (1 << 33) - 1


def common_prefix(a, b) -> Column:
    """Number of leading characters that two texts share, by halving; null if one is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def search(p: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            same = F.substring(p["a"], F.lit(1), mid) == F.substring(p["b"], F.lit(1), mid)
            return F.when(s["lo"] == s["hi"], s).when(same, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))

        most = F.least(F.length(p["a"]), F.length(p["b"]))
        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda s: s["lo"])

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), search))


def in_prefix_order(prompts: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """prompts with given, place and reused: their place before and in the order, from 0, and the characters shared with the prompt before.

    Prompts are sorted by ranges of `order`, ties by their given place; the first prompt shares nothing, nor does one beside a null. Neighbours meet
    within their range; the first prompt of a range meets the last one of the range before, a row for each range. given
    numbers the rows in the order in which the input is read: sort by it to restore that order.
    """
    rows = prompts.withColumn("given", F.monotonically_increasing_id())
    laid = written(rows.orderBy(*order, "given").withColumn("_at", F.monotonically_increasing_id()), "prefix-order")
    part = F.shiftright("_at", _PART)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))  # a row for each range
    w = Window.orderBy("_part")
    begins = written(sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"), F.lag("_last").over(w).alias("_before")), "ranges")
    ends = begins.where("_before is not null").join(laid.select(F.col("_at").alias("_before"), F.col(text).alias("_end")), "_before").select("_part", "_end")
    inside = laid.withColumn("_part", part).withColumn("_prev", F.lag(text).over(Window.partitionBy("_part").orderBy("_at")))
    joined = inside.join(F.broadcast(begins.select("_part", "_first", "_begin")), "_part").join(ends, "_part", "left")
    prev = F.when(F.col("_at") == F.col("_first"), F.col("_end")).otherwise(F.col("_prev"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(_WITHIN)
    return joined.select(*[F.col(f"`{c}`") for c in prompts.columns], "given", place.alias("place"), F.coalesce(common_prefix(prev, F.col(text)), F.lit(0)).cast("long").alias("reused"))


def restored(rows: DataFrame) -> DataFrame:
    """Rows of in_prefix_order in their given order."""
    return rows.orderBy("given").drop("given", "place", "reused")
