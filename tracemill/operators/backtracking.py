"""Backtracking verdicts: summaries, lists, leaderboard, coverage, targets, merges, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators import stats
from tracemill.operators.traces import first_of_groups
from tracemill.schema import KEY


def with_scores(bt: DataFrame, traces: DataFrame) -> DataFrame:
    return bt.join(traces.select(*KEY, "score"), list(KEY), "left")


def summary(bt: DataFrame, traces: DataFrame) -> DataFrame:
    """Measures of each model; a verdict without a scored trace is neither correct nor incorrect, but lowers accuracy."""
    hit, good, bad = F.col("backtracking_detected") == 1, F.col("score") > 0.5, F.col("score") <= 0.5
    return with_scores(bt, traces).groupBy("dataset", "model").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("detected"), F.avg(F.when(hit, F.col("num_backtracking_steps"))).alias("avg_steps"), F.avg("confidence").alias("avg_confidence"),
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("trace_accuracy"), F.count_if(good).alias("correct"), F.count_if(bad).alias("incorrect"), F.count_if(good & hit).alias("correct_detected"), F.count_if(bad & hit).alias("incorrect_detected"),
    )


def trace_list(bt: DataFrame, traces: DataFrame, detected: bool | None = None, correctness: str | None = None, order: str = "index", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of verdicts: filtered by detection (absent counts as not) and correctness, in one of three orders."""
    if order not in ("index", "steps", "confidence") or correctness not in (None, "correct", "incorrect"):
        raise ValueError("unknown order or correctness")
    df = with_scores(bt, traces)
    if detected is not None:
        df = df.where("backtracking_detected = 1" if detected else "backtracking_detected = 0 or backtracking_detected is null")
    if correctness:
        df = df.where("score > 0.5" if correctness == "correct" else "score <= 0.5")
    steps, sure = F.coalesce("num_backtracking_steps", F.lit(-1)).desc(), F.coalesce("confidence", F.lit(-1.0)).desc()
    first = {"index": [], "steps": [steps], "confidence": [sure]}[order]
    return df.orderBy(*first, "trace_index", "dataset", "model").offset(max(0, offset)).limit(min(2000, max(1, limit)))


def leaderboard(meta: DataFrame, bt: DataFrame, traces: DataFrame) -> DataFrame:
    """Model metadata with detection rates, overall and by correctness; models without verdicts stay."""
    s = summary(bt, traces).select(
        "dataset", "model", F.col("total").alias("bt_total"), F.col("detected").alias("bt_detected"), F.col("avg_steps").alias("bt_avg_steps"), F.col("avg_confidence").alias("bt_avg_confidence"),
        F.try_divide(F.col("detected"), F.col("total")).alias("bt_rate"), F.try_divide(F.col("correct_detected"), F.col("correct")).alias("bt_rate_correct"), F.try_divide(F.col("incorrect_detected"), F.col("incorrect")).alias("bt_rate_incorrect"),
    )
    return meta.join(s, ["dataset", "model"], "left")


def correlation(bt: DataFrame, traces: DataFrame) -> DataFrame:
    """Detected verdicts, their mean steps, correct counts, and the correlation of steps with correctness."""
    df = with_scores(bt, traces).withColumn("ok", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)).withColumn("k", F.col("num_backtracking_steps").cast("double"))
    return df.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("backtracking_detected") == 1).alias("detected"), F.avg(F.when(F.col("backtracking_detected") == 1, F.col("k"))).alias("avg_steps"), F.sum("ok").cast("long").alias("correct"), stats.pearson("k", "ok").alias("r"))


def table(bt: DataFrame, traces: DataFrame) -> DataFrame:
    """Mean and deviation of steps of each model, by correctness, with marks for the dataset's extremes."""
    df = with_scores(bt, traces).withColumn("k", F.col("num_backtracking_steps").cast("double"))
    m = df.groupBy("dataset", "model").agg(F.avg("k").alias("mean_steps"), F.stddev_samp("k").alias("std_steps"), F.avg(F.when(F.col("score") > 0.5, F.col("k"))).alias("mean_correct"), F.avg(F.when(F.col("score") <= 0.5, F.col("k"))).alias("mean_incorrect"))
    w = Window.partitionBy("dataset")
    return m.withColumn("is_max", F.col("mean_steps") == F.max("mean_steps").over(w)).withColumn("is_min", F.col("mean_steps") == F.min("mean_steps").over(w))


def latex_rows(tab: DataFrame) -> DataFrame:
    """One LaTeX row for each model: the dataset's largest mean in bold, the smallest underlined."""
    value = F.format_string("%.2f", F.col("mean_steps"))
    cell = F.when(F.col("is_max"), F.concat(F.lit("\\textbf{"), value, F.lit("}"))).when(F.col("is_min"), F.concat(F.lit("\\underline{"), value, F.lit("}"))).otherwise(value)
    return tab.select("dataset", "model", F.concat_ws(" & ", "model", cell).alias("row"))


def coverage(bt: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces that need a verdict, that have one, and that have one without error."""
    df = traces.select(*KEY).join(bt.select(*KEY, "error", F.lit(True).alias("has")), list(KEY), "left")
    return df.groupBy("dataset", "model").agg(F.count("*").alias("needed"), F.count("has").alias("processed"), F.count_if(F.col("has") & F.col("error").isNull()).alias("ok"))


def targets(available: DataFrame, processed: DataFrame, failed: DataFrame, inflight: DataFrame) -> DataFrame:
    """Keys to submit: those not processed, and failed ones, less those on their way."""
    k = list(KEY)
    fresh = available.select(*k).join(processed.select(*k), k, "left_anti")
    again = failed.select(*k).join(available.select(*k), k, "left_semi")
    return fresh.unionByName(again).distinct().join(inflight.select(*k), k, "left_anti")


def inflight_keys(batches: DataFrame) -> DataFrame:
    """Keys of unfinished batches: their listed indices, or the half-open range of the older form."""
    span = F.when(F.col("end_index") > F.col("start_index"), F.sequence("start_index", F.col("end_index") - 1)).otherwise(F.array().cast("array<bigint>"))
    live = batches.where(~F.coalesce(F.col("status"), F.lit("")).isin("completed", "failed", "cancelled", "expired"))
    return live.select("dataset", "model", F.explode(F.coalesce("indices", span)).alias("trace_index")).distinct()


def merge(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """One verdict for each key: a success replaces all before it, an error only what is missing or an error.

    Among successes the latest batch wins, among errors the latest too. Both sides have batch_seq.
    """
    order = Window.partitionBy(*KEY).orderBy(F.when(F.col("error").isNull(), 0).otherwise(1), F.col("batch_seq").desc())
    return existing.unionByName(arrivals).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def cost_estimate(prompts: DataFrame, price_in: float, price_out: float, fail_rate: float = 0.1, sample: int = 50, output_tokens: float = 2048.0) -> DataFrame:
    """Cost of what remains of each pair, from the mean prompt length of its first traces.

    prompts has (dataset, model, trace_index, prompt_tokens, output_tokens or null, done).
    """
    by = ["dataset", "model"]
    left = prompts.groupBy(*by).agg(F.count_if(~F.col("done")).alias("remaining")).alias("a")
    means = first_of_groups(prompts, by, "trace_index", sample).groupBy(*by).agg(F.avg("prompt_tokens").alias("mean_prompt"), F.coalesce(F.avg("output_tokens"), F.lit(output_tokens)).alias("mean_output")).alias("b")
    m = left.join(means, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]).select("a.*", "b.mean_prompt", "b.mean_output")
    calls = F.col("remaining") * (1 + fail_rate)
    return m.withColumn("cost_usd", calls * (F.col("mean_prompt") * price_in + F.col("mean_output") * price_out) / 1e6)


def cost_total(estimates: DataFrame) -> DataFrame:
    """One row: calls that remain over all pairs, the number of pairs, and what they cost."""
    return estimates.agg(F.sum("remaining").cast("long").alias("remaining"), F.count("*").alias("pairs"), F.sum("cost_usd").alias("cost_usd"))


def failed_pool(before: DataFrame, succeeded: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Keys that are to be tried again: those of before without the successes, and those whose reply did not parse."""
    k = list(KEY)
    return before.select(*k).join(succeeded.select(*k), k, "left_anti").unionByName(unparsed.select(*k)).distinct()
