"""Data behind the dashboard's endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_optional(rows: DataFrame, more: DataFrame | None, key: list[str], prefix: str = "") -> DataFrame:
    """Rows with the columns of a table that may be missing; all rows stay."""
    if more is None:
        return rows
    renamed = more.select(*key, *[F.col(c).alias(prefix + c) for c in more.columns if c not in key])
    return rows.join(renamed, key, "left")


def boosted(traces: DataFrame) -> DataFrame:
    """Mean score, and mean of those right or with the answer anywhere in the trace; a missing score is 0."""
    hit = (F.col("score") == 1) | F.contains("trace_text", "answer")
    return traces.groupBy("dataset", "model").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("average_score"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("average_boosted"))


def error_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset").agg(F.count("*").alias("total"), F.count("error").alias("errors"), F.try_divide(100.0 * F.count("error"), F.count("*")).alias("error_percentage"))


#: Fixed value: the error of a grading that took too long.
TIMEOUT = "Timeout after 10 seconds"


def grading_classes(results: DataFrame) -> DataFrame:
    """Numbers and percentages of gradings that went well, took too long, or failed, and of right answers."""
    why = F.col("error")
    counts = {"successful": F.count_if(why.isNull()), "timeouts": F.count_if(why == TIMEOUT), "exceptions": F.count_if(why != TIMEOUT), "correct": F.count_if(F.col("score") == 1)}
    named = {"successful": "successful", "timeouts": "timeout", "exceptions": "exception", "correct": "correct"}
    return results.groupBy("dataset").agg(F.count("*").alias("total"), *[v.alias(k) for k, v in counts.items()], *[F.try_divide(100.0 * v, F.count("*")).alias(f"{named[k]}_percentage") for k, v in counts.items()])


def index_summary(joined: DataFrame) -> DataFrame:
    return joined.groupBy("dataset").agg(F.count("*").alias("traces"), F.avg("score").alias("accuracy"), *[f(c).alias(f"{n}_{k}") for c, k in (("token_count", "tokens"), ("redundancy_score", "redundancy")) for n, f in (("mean", F.avg), ("median", F.median))])


def square(pairs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long pairs as a symmetric matrix with ones on the diagonal; what is missing is null."""
    flipped = pairs.select(*by, F.col("metric_y").alias("metric_x"), F.col("metric_x").alias("metric_y"), "r")
    both = pairs.select(*by, "metric_x", "metric_y", "r").unionByName(flipped)
    wide = both.groupBy(*by, "metric_x").pivot("metric_y", metrics).agg(F.first("r"))
    return wide.select(*by, "metric_x", *[F.when(F.col("metric_x") == m, 1.0).otherwise(F.col(m)).alias(m) for m in metrics])


def condition_key(dataset: str, model: str, correctness: str) -> tuple[str, str]:
    """Which family of conditions, and which group in it, a request asks for."""
    if correctness not in ("all", "correct_only", "incorrect_only"):
        raise ValueError(f"unknown correctness {correctness}")
    named = [n for n, v in (("dataset", dataset), ("model", model)) if v != "all"]
    family = "by_" + "_".join(named) if named else "unconditional"
    group = "::".join(v for v in (dataset, model) if v != "all") or "all"
    return family + ("" if correctness == "all" else f"__{correctness}"), group


def served_correlations(rows: DataFrame, dataset: str, model: str, correctness: str, metrics: list[str], name: str = "all") -> DataFrame:
    """The rows of one condition among the metrics of a preset, with labels for reading."""
    from tracemill.functions.text import metric_label

    family, group = condition_key(dataset, model, correctness)
    chosen = preset(metrics, name)
    kept = rows.where((F.col("condition") == family) & (F.col("grp") == group) & F.col("metric_x").isin(*chosen) & F.col("metric_y").isin(*chosen))
    return kept.withColumn("label_x", metric_label("metric_x")).withColumn("label_y", metric_label("metric_y"))


#: Metrics of the core preset besides rewards.
CORE = ("trace_score", "trace_correct", "pu_avg_correctness", "pu_linearity_mse", "pu_regression_rate")


def preset(metrics: list[str], name: str) -> list[str]:
    """Metrics of a preset, in their order."""
    tests = {
        "all": lambda m: True,
        "rm_only": lambda m: m.startswith("rm::"),
        "pu_only": lambda m: m.startswith("pu_"),
        "rm_pu": lambda m: m.startswith(("rm::", "pu_")),
        "core": lambda m: m in CORE or m.startswith("rm::"),
    }
    if name not in tests:
        raise ValueError(f"unknown preset {name}")
    return [m for m in metrics if tests[name](m)]
