"""Transfer-utility records: regressions, bins, per-trace metrics, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators import stats
from tracemill.schema import CURVE, correct, normalised


def taught_well(pu: DataFrame) -> DataFrame:
    """Records of traces whose teacher was right."""
    return pu.where("teacher_score > 0.5")


def _totals(events: DataFrame) -> DataFrame:
    out = events.groupBy(*CURVE).agg(F.count("*").alias("total_questions"), F.count_if(F.col("regressions") > 0).alias("regressed_questions"), F.sum("regressions").cast("long").alias("total_regressions"))
    return out.withColumn("regression_percentage", 100.0 * F.col("regressed_questions") / F.col("total_questions")).withColumn("avg_regressions_per_question", F.col("total_regressions") / F.col("total_questions"))


def by_trace(pu: DataFrame) -> DataFrame:
    """Records dealt out by trace: one shuffle serves the step means, the windows and the traces' own aggregates."""
    return pu.repartition(*CURVE, "trace_index")


def step_means(pu: DataFrame) -> DataFrame:
    return by_trace(pu).groupBy(*CURVE, "trace_index", "num_steps").agg(F.avg(correct()).alias("mean_correct"), F.avg(normalised()).alias("mean_score"))


def regressions(pu: DataFrame) -> DataFrame:
    """Falls from mostly right to mostly wrong between neighbouring prefix lengths, summed for each curve."""
    w = Window.partitionBy(*CURVE, "trace_index").orderBy("num_steps")
    falls = step_means(taught_well(pu)).withColumn("prev", F.lag("mean_correct").over(w))
    events = falls.groupBy(*CURVE, "trace_index").agg(F.count_if((F.col("prev") >= 0.5) & (F.col("mean_correct") < 0.5)).alias("regressions"))
    return _totals(events)


def latched_regressions(pu: DataFrame) -> DataFrame:
    """Wrong answers after a right one, however long ago, summed for each curve."""
    w = Window.partitionBy(*CURVE, "trace_index").orderBy("num_steps").rowsBetween(Window.unboundedPreceding, -1)
    seen = taught_well(pu).withColumn("seen", F.max(F.col("score") == 1).over(w))
    return _totals(seen.groupBy(*CURVE, "trace_index").agg(F.count_if(F.col("seen") & (F.col("score") == 0)).alias("regressions")))


def percentage_bins(pu: DataFrame) -> DataFrame:
    """Mean, population deviation and number of scores in bins of two per cent, by bin centre."""
    binned = taught_well(pu).withColumn("bin_center", F.floor(F.col("percentage_complete") / 2).cast("long") * 2 + 1)
    return binned.groupBy(*CURVE, "bin_center").agg(F.avg(normalised()).alias("mean_correct"), F.stddev_pop(normalised()).alias("std_correct"), F.count("*").alias("count"))


def absolute_bins(pu: DataFrame, size: int = 10, least: int = 10) -> DataFrame:
    """The same in bins of prefix length; bins of few samples are left out."""
    binned = taught_well(pu).withColumn("bin_center", F.floor(F.col("num_steps") / size).cast("long") * size + size / 2.0)
    out = binned.groupBy(*CURVE, "bin_center").agg(F.avg(normalised()).alias("mean_correct"), F.stddev_pop(normalised()).alias("std_correct"), F.count("*").alias("count"))
    return out.where(F.col("count") >= least)


def _with_longest(pu: DataFrame) -> DataFrame:
    """Records with their teacher's longest prefix, which is aggregated, not sorted for."""
    return pu.join(pu.groupBy("dataset", "teacher_model").agg(F.max("num_steps").alias("_top")), ["dataset", "teacher_model"])


def step_bins(pu: DataFrame, width: int = 2, least: int = 10) -> DataFrame:
    """Left-closed bins of prefix length with sample deviation; a last edge at an even maximum is outside."""
    last = F.ceil((F.col("_top") + width) / width).cast("long") * width - width
    inside = _with_longest(pu).withColumn("_last", last).where(F.col("num_steps") < F.col("_last"))
    binned = inside.withColumn("bin", F.floor(F.col("num_steps") / width).cast("long") * width + width / 2.0)
    out = binned.groupBy("dataset", "teacher_model", "bin").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("*").alias("count"))
    return out.where(F.col("count") >= least)


def percent_of_max_bins(pu: DataFrame, least: int = 10) -> DataFrame:
    """Bins of two per cent of the teacher's longest prefix; the full length itself is outside."""
    pct = _with_longest(pu).withColumn("pct", F.try_divide(F.col("num_steps").cast("double") * 100, F.col("_top"))).where("pct < 100")
    binned = pct.withColumn("bin", F.floor(F.col("pct") / 2).cast("long") * 2 + 1.0)
    out = binned.groupBy("dataset", "teacher_model", "bin").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("*").alias("count"))
    return out.where(F.col("count") >= least)


def trace_metrics(pu: DataFrame) -> DataFrame:
    """Average correctness, linearity error and regression rate of each trace and student."""
    w = Window.partitionBy(*CURVE, "trace_index").orderBy("num_steps")
    s = step_means(pu).withColumn("prev", F.lag("mean_correct").over(w)).withColumn("x", F.col("num_steps").cast("double"))
    curve = s.groupBy(*CURVE, "trace_index").agg(
        F.when(F.count("*") >= 2, stats.fit_mse("mean_score", "x")).alias("linearity_mse"),
        F.try_divide(F.count_if((F.col("prev") >= 0.5) & (F.col("mean_correct") < 0.5)), F.count("prev")).alias("regression_rate"),
    )
    avg = by_trace(pu).groupBy(*CURVE, "trace_index").agg(F.avg(correct()).alias("avg_correct"))
    return avg.join(curve, [*CURVE, "trace_index"])


def trace_metrics_of_students(metrics: DataFrame) -> DataFrame:
    """The same, averaged over students; what a student lacks is skipped."""
    return metrics.groupBy("dataset", F.col("teacher_model").alias("model"), "trace_index").agg(*[F.avg(c).alias(c) for c in ("avg_correct", "linearity_mse", "regression_rate")])


def overall(pu: DataFrame) -> DataFrame:
    """Mean, sample deviation and number of scores of each teacher, and accuracy without any prefix."""
    return pu.groupBy("dataset", "teacher_model").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.count("*").alias("count"), F.avg(F.when(F.col("num_steps") == 0, F.col("score"))).alias("j0_accuracy"))


def samples_in_bin(pu: DataFrame, traces: DataFrame, center: float, k: int, seed: int = 1) -> DataFrame:
    """k records of the bin around center, picked by a hash, with their traces' text."""
    picked = taught_well(pu).where((F.col("percentage_complete") >= center - 1) & (F.col("percentage_complete") < center + 1))
    key = F.md5(F.concat_ws("|", F.col("trace_index").cast("string"), F.col("num_steps").cast("string"), "student_model", F.lit(str(seed))))
    top = picked.withColumn("pick", key).orderBy("pick").limit(k)
    # k rows: a proven bound for the broadcast
    return traces.select(F.col("trace_index"), "trace_text").join(F.broadcast(top), "trace_index")


def leaderboard_regressions(reg: DataFrame) -> DataFrame:
    """Sums over students, and the unweighted mean of their percentages."""
    return reg.groupBy("dataset", F.col("teacher_model").alias("model")).agg(*[F.sum(c).cast("long").alias(c) for c in ("total_questions", "regressed_questions", "total_regressions")], F.avg("regression_percentage").alias("regression_percentage"))


def without_answer(records: DataFrame) -> DataFrame:
    """Records whose extracted answer is missing or empty: they get a second pass."""
    return records.where("extracted_answer is null or extracted_answer = ''")


def with_teacher_scores(records: DataFrame, scores: DataFrame, place: str) -> DataFrame:
    """Records with teacher_score from (dataset, model, trace_index, score): the row of the same dataset and teacher, the last by place.

    One row comes out for each that goes in; records of unknown traces stay with null.
    """
    known = scores.groupBy("dataset", F.col("model").alias("teacher_model"), "trace_index").agg(F.max_by("score", place).alias("teacher_score"))
    return records.join(known, ["dataset", "teacher_model", "trace_index"], "left")
