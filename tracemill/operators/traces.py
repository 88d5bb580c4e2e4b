"""Joins and summaries of traces: pages, metadata, efficiency, redundancy, rewards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators import stats
from tracemill.schema import KEY


def with_metrics(traces: DataFrame, eff: DataFrame, red: DataFrame) -> DataFrame:
    k = list(KEY)
    return traces.join(eff.select(*k, "token_count", "sentence_count"), k, "left").join(red.select(*k, "redundancy_score"), k, "left")


def page(joined: DataFrame, low: float | None, high: float | None, page_no: int, size: int) -> DataFrame:
    """A page of traces in order of index, optionally within a range of scores."""
    if low is not None:
        joined = joined.where(F.col("score") >= low)
    if high is not None:
        joined = joined.where(F.col("score") <= high)
    return joined.orderBy("trace_index").offset(page_no * size).limit(size)


def metadata(joined: DataFrame) -> DataFrame:
    """Counts and averages of each model; an average of zero stays zero."""
    return joined.groupBy("dataset", "model").agg(F.count("*").alias("total_traces"), F.avg("score").alias("accuracy"), F.avg("token_count").alias("avg_tokens"), F.avg("redundancy_score").alias("avg_redundancy"))


def models_summary(meta: DataFrame) -> DataFrame:
    """Correct and incorrect counts, the product truncated."""
    right = F.floor(F.coalesce("accuracy", F.lit(0.0)) * F.col("total_traces")).cast("long")
    return meta.select("dataset", "model", "total_traces", right.alias("correct"), (F.col("total_traces") - right).alias("incorrect"))


def by_model(joined: DataFrame) -> DataFrame:
    """Mean and median of tokens, sentences and redundancy of each model."""
    return joined.groupBy("dataset", "model").agg(*[f(c).alias(f"{n}_{c}") for c in ("token_count", "sentence_count", "redundancy_score") for n, f in (("mean", F.avg), ("median", F.median))])


def length_stats(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Number, mean, sample deviation, and means by correctness of each column, with its correlation with the score."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_samp(x).alias(f"std_{c}"), F.avg(F.when(F.col("score") > 0.5, x)).alias(f"mean_{c}_correct"), F.avg(F.when(F.col("score") <= 0.5, x)).alias(f"mean_{c}_incorrect"), stats.pearson(x, F.col("score")).alias(f"r_{c}_score")]
    return joined.groupBy("dataset").agg(*aggs)


#: Steps that a block of a trace holds.
STEP_BLOCK = 256


def _best_of_block(late: pd.DataFrame, early: pd.DataFrame) -> pd.DataFrame:
    """For each later step its closest step of the early block, the earliest on ties: (trace_index, step, best, prior).

    Sums run over the components in their order, so equal vectors have equal sums wherever they stand.
    """
    early, width = early.sort_values("step"), min(len(late["embedding"].iloc[0]), len(early["embedding"].iloc[0]))
    x, y = (np.array([v[:width] for v in d["embedding"]], np.float64).reshape(len(d), width) for d in (late, early))
    sim = np.zeros((len(late), len(early)))
    for d in range(width):
        sim += x[:, d, None] * y[None, :, d]
    before = early["step"].to_numpy()[None, :] < late["step"].to_numpy()[:, None]
    sim = np.where(before, sim, -np.inf)
    at = sim.argmax(axis=1) if len(early) else np.zeros(len(late), int)
    got = pd.DataFrame({"trace_index": late["trace_index"].to_numpy(), "step": late["step"].to_numpy(), "best": sim[np.arange(len(late)), at], "prior": early["step"].to_numpy()[at]})
    return got[before.any(axis=1)]


def redundancy_per_step(steps: DataFrame, block: int = STEP_BLOCK) -> DataFrame:
    """(trace_index, step, best, match): each step's closest earlier step, the earliest on ties; 0 and -1 for the first.

    Vectors of a trace are of one length. A trace's steps are cut into blocks, and each two blocks meet in a task of their own, which
    gives a row for each later step: what is written grows with a trace's steps times its blocks, not with its pairs.
    """
    rows = steps.select(F.col("trace_index").cast("long").alias("trace_index"), F.col("step").cast("long").alias("step"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.floor(F.col("step") / block).cast("long").alias("_b"))
    last = rows.groupBy("trace_index").agg(F.max("_b").alias("_last"))
    late = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "_b"))).withColumnRenamed("_b", "j")
    early = rows.join(last, "trace_index").withColumn("j", F.explode(F.sequence("_b", "_last"))).withColumnRenamed("_b", "i").drop("_last")
    early = early.select(*[F.col(c).alias(f"{c}_e") for c in early.columns])  # of one lineage with the other side, so by names of its own
    cell = ["trace_index", "i", "j"]
    schema = "trace_index long, step long, best double, prior long"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns=lambda c: c.removesuffix("_e"))
        return _best_of_block(a, b) if len(a) and len(b) else pd.DataFrame({"trace_index": [], "step": [], "best": [], "prior": []})

    found = late.groupBy(*cell).cogroup(early.groupBy(*[f"{c}_e" for c in cell])).applyInPandas(meet, schema)
    best = found.groupBy("trace_index", "step").agg(F.max(F.struct("best", (-F.col("prior")).alias("prior"))).alias("m")).select("trace_index", "step", "m.best", (-F.col("m.prior")).alias("match"))
    return rows.select("trace_index", "step").join(best, ["trace_index", "step"], "left").select("trace_index", "step", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("match", F.lit(-1)).cast("long").alias("match"))


def redundancy_stats(per_step: DataFrame, threshold: float) -> DataFrame:
    """Share of a trace's later steps that are closer to an earlier one than the threshold."""
    later = F.col("step") > 0
    return per_step.groupBy("trace_index").agg(F.count("*").alias("steps"), F.coalesce(F.try_divide(F.count_if(later & (F.col("best") > threshold)), F.count_if(later)), F.lit(0.0)).alias("redundancy_score"), F.avg(F.when(later, F.col("best"))).alias("mean_best"))


def reward_pivot(rewards: DataFrame, names: list[str]) -> DataFrame:
    """One column for each reward model (mean of repeats), and the mean of those present."""
    wide = rewards.groupBy(*KEY).pivot("rm", names).agg(F.avg("reward"))
    present = F.array_compact(F.array(*names))
    return wide.withColumn("rm_mean", F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, b: a + b), F.size(present)))


def reward_stats(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("dataset", "rm").agg(F.count("reward").alias("n"), F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("std"), F.min("reward").alias("min"), F.max("reward").alias("max"))


def utility_reward_correlation(per_trace: DataFrame, rewards_wide: DataFrame, correctness: DataFrame, metrics: list[str]) -> DataFrame:
    """(condition, dataset, metric, n, r): correlation of utility with reward, for all traces and correct ones.

    Inner join with rewards, left join with correctness (absent is wrong); each trace is expanded to
    the conditions that it belongs to, so one aggregate serves all of them.
    """
    k = list(KEY)
    df = per_trace.join(rewards_wide.select(*k, "rm_mean"), k).join(correctness.select(*k, "trace_correct"), k, "left").withColumn("trace_correct", F.coalesce("trace_correct", F.lit(False)))
    conds = F.when(F.col("trace_correct"), F.array(F.lit("unconditional"), F.lit("correct_only"))).otherwise(F.array(F.lit("unconditional")))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    rows = df.select(F.explode(F.array(F.lit("overall"), F.col("dataset"))).alias("dataset"), "rm_mean", conds.alias("conds"), cells.alias("cells")).select("dataset", "rm_mean", "cells", F.explode("conds").alias("condition")).select("dataset", "rm_mean", "condition", F.explode("cells").alias("c"))
    ok = stats.finite_pair("c.value", "rm_mean")
    return rows.where(ok).groupBy("condition", "dataset", F.col("c.metric").alias("metric")).agg(F.count("*").alias("n"), stats.pearson("c.value", "rm_mean").alias("r")).where("n >= 3")


def per_model_means(rows: DataFrame, by_model: str) -> DataFrame:
    """(dataset, rm, n, mean) of what the maps of rewards by model hold; null rewards don't count."""
    each = rows.select("dataset", F.explode(by_model).alias("rm", "reward")).where("reward is not null")
    return each.groupBy("dataset", "rm").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"))


def with_last(rows: DataFrame, lookup: DataFrame, key: list[str], place: str, values: list[str]) -> DataFrame:
    """Rows with a lookup's values; of lookup rows that repeat a key the last by place counts, so no row is multiplied."""
    last = lookup.groupBy(*key).agg(F.max(F.struct(place, *values)).alias("_l"))
    return rows.join(last.select(*key, *[F.col("_l")[v].alias(v) for v in values]), key, "left")


def first_of_groups(df: DataFrame, by: list[str], order: str, most: int, parts: int = 64) -> DataFrame:
    """The first `most` rows of each group by order; rows are chosen within parts of a group first, so that no task ranks a whole one."""
    few = df.withColumn("_p", F.pmod(F.xxhash64(order), F.lit(parts))).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(order))).where(F.col("_r") <= most)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= most).drop("_p", "_r")


def metric_arrays(joined: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(dataset, model, columns): arrays of each model's first `most` traces by index, nulls left out."""
    by = ["dataset", "model"]
    kept = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("trace_index", c)))), lambda p: p[c])
    return first_of_groups(joined, by, "trace_index", most).groupBy(*by).agg(*[kept(c).alias(c) for c in columns])
