"""Curves of binned means: fits, areas, variation, penalties, smoothing, entropy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators import stats


def area(by: list[str], x: str, y: str):
    """Window columns for the trapezoid rule: each row's part of the area under its curve."""
    w = Window.partitionBy(*by).orderBy(x)
    return (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0


def over_students(bins: DataFrame) -> DataFrame:
    """Unweighted mean over students of each bin."""
    return bins.groupBy("dataset", F.col("teacher_model").alias("model"), F.col("bin_center").cast("double").alias("x")).agg(F.avg("mean_correct").alias("y"), F.sum("count").cast("long").alias("n"))


def leaderboard(curve: DataFrame) -> DataFrame:
    """Mean, slope, r2, error and normalised area of each model's curve; null under two points."""
    by = ["dataset", "model"]
    a = curve.withColumn("part", area(by, "x", "y"))
    two = F.count("*") >= 2
    return a.groupBy(*by).agg(
        F.sum("n").cast("long").alias("total_count"), F.avg("y").alias("mean_accuracy"), F.when(two, stats.slope("y", "x")).alias("slope"), F.when(two, stats.r_squared("y", "x")).alias("r2"), F.when(two, stats.fit_mse("y", "x")).alias("mse"),
        F.when(two, F.coalesce(F.try_divide(F.sum("part"), F.max("x") - F.min("x")), F.lit(0.0))).alias("auc"),
    )


def fits(curve: DataFrame) -> DataFrame:
    """Linear and logarithmic least-squares fits of curves of three points or more."""
    c = curve.withColumn("lx", F.ln(F.col("x") + 1))
    out = c.groupBy("dataset", "model").agg(F.count("*").alias("points"), *[f(y, x).alias(f"{name}_{kind}") for kind, y, x in (("linear", "y", "x"), ("log", "y", "lx")) for name, f in (("slope", stats.slope), ("intercept", stats.intercept), ("mse", stats.fit_mse), ("r2", stats.r_squared))])
    return out.where("points >= 3")


def total_variation(curve: DataFrame) -> DataFrame:
    """Sum of steps, the same over the range, and the mean step."""
    w = Window.partitionBy("dataset", "model").orderBy("x")
    d = curve.withColumn("d", F.abs(F.col("y") - F.lag("y").over(w)))
    tv = F.coalesce(F.sum("d"), F.lit(0.0))
    return d.groupBy("dataset", "model").agg(tv.alias("total_variation"), F.coalesce(F.try_divide(tv, F.max("y") - F.min("y")), F.lit(0.0)).alias("normalized_tv"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_step"))


def penalised_area(curve: DataFrame, weight: float = 0.1) -> DataFrame:
    """Normalised area less penalties for length, spread and roughness, relative to the dataset's largest."""
    by = ["dataset", "model"]
    w = Window.partitionBy(*by).orderBy("x")
    c = curve.withColumn("part", area(by, "x", "y")).withColumn("d", F.abs(F.col("y") - F.lag("y").over(w)))
    m = c.groupBy(*by).agg(F.count("*").alias("points"), F.sum("part").alias("raw_auc"), F.coalesce(F.try_divide(F.sum("part"), F.max("x") - F.min("x")), F.sum("part")).alias("normalized_auc"), F.avg("x").alias("mean_steps"), F.stddev_pop("x").alias("step_std"), F.avg("d").alias("roughness")).where("points >= 2")
    top = Window.partitionBy("dataset")
    several = F.count("*").over(top) > 1
    part = lambda c: weight * F.coalesce(F.try_divide(F.col(c), F.max(c).over(top)), F.lit(0.0))
    out = m.withColumn("length_penalty", F.when(several, part("mean_steps"))).withColumn("concentration_penalty", F.when(several, part("step_std"))).withColumn("smoothness_penalty", F.when(several, weight * F.col("roughness")))
    return out.withColumn("penalized_auc", F.col("normalized_auc") - F.col("length_penalty") - F.col("concentration_penalty") - F.col("smoothness_penalty")).drop("points")


def rankings(curve: DataFrame) -> DataFrame:
    """Places in each dataset by penalised area, by error of the line, by explained variance; ties share a place, missing values come last."""
    both = penalised_area(curve).join(leaderboard(curve).select("dataset", "model", "mse", "r2"), ["dataset", "model"])
    place = lambda o: F.rank().over(Window.partitionBy("dataset").orderBy(o)).cast("long")  # noqa: E731  a row for each model
    return both.select("dataset", "model", place(F.round("penalized_auc", 6).desc_nulls_last()).alias("by_penalised_area"), place(F.round("mse", 9).asc_nulls_last()).alias("by_smoothness"), place(F.round("r2", 6).desc_nulls_last()).alias("by_r2"))


def smoothed(curve: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing over neighbouring points, the curve mirrored at its ends; short curves stay as they are."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [r / sum(raw) for r in raw]
    arr = curve.groupBy("dataset", "model").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))  # a curve has at most as many points as there are bins
    n = F.size("p")

    def at(i):
        j = F.pmod(i, 2 * n)
        return F.element_at(F.col("p"), F.when(j < n, j + 1).otherwise(2 * n - j).cast("int"))["y"]

    def smooth(pt, i):
        total = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), weights):
            total = total + at(i + k) * F.lit(w)
        return F.struct(pt["x"].alias("x"), F.when(n >= 3, total).otherwise(pt["y"]).alias("y"))

    return arr.select("dataset", "model", F.explode(F.transform("p", smooth)).alias("q")).select("dataset", "model", "q.x", "q.y")


def entropy(mass: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy of non-negative masses, normalised by that of equal ones; null without mass or with one row."""
    total = F.sum(value).over(Window.partitionBy(*by))
    q = mass.withColumn("_q", F.try_divide(F.col(value), total))
    return q.groupBy(*by).agg(F.count("*").alias("bins"), F.when(F.count("*") > 1, F.try_divide(F.sum(-F.col("_q") * F.ln(F.col("_q") + 1e-12)), F.ln(F.count("*").cast("double")))).alias("entropy"))


def error_band(bins: DataFrame, by: list[str], narrow: float = 1.0, wide: float = 4.0) -> DataFrame:
    """(by, bin_center, lower, upper, line_width): bins with one standard error to either side, and a width by count."""
    err = F.col("std_correct") / F.sqrt(F.greatest(F.col("count"), F.lit(1)))
    ends = bins.groupBy(*by).agg(F.min("count").alias("_lo"), F.max("count").alias("_hi"))
    width = F.when(F.col("_hi") == F.col("_lo"), (narrow + wide) / 2).otherwise(narrow + (wide - narrow) * (F.col("count") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return bins.join(ends, by).select(*by, "bin_center", (F.col("mean_correct") - err).alias("lower"), (F.col("mean_correct") + err).alias("upper"), width.alias("line_width"))
