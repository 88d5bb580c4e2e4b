"""Artifacts of runs as tables: many files with the metadata of their paths, tolerant results, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.jsonparse import verdict
from tracemill.functions.text import canonical_model


def finite(x: Column) -> Column:
    """x, or null if it is no finite number."""
    v = x.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def reward_of_row(reward: str = "reward", rm_reward: str = "rm_reward", score: str = "score", by_model: str = "rewards_by_model") -> Column:
    """The first number of reward, rm_reward, score, and then of the map of rewards by model; null if none is."""
    first = F.try_element_at(F.filter(F.transform(F.map_values(F.col(by_model)), lambda v: finite(v)), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(finite(F.col(reward)), finite(F.col(rm_reward)), finite(F.col(score)), first)


def with_paths(wanted: DataFrame, known: DataFrame, file: str) -> DataFrame:
    """(dataset, model, path, there): where each pair's artifact lies, and whether known has it."""
    there = known.select("dataset", "model", F.lit(True).alias("there")).distinct()
    path = F.concat_ws("/", "dataset", "model", F.lit(file))
    return wanted.join(there, ["dataset", "model"], "left").select("dataset", "model", path.alias("path"), F.coalesce("there", F.lit(False)).alias("there"))


def found_paths(spark: SparkSession, base: str, pattern: str = "*.pkl") -> DataFrame:
    """(dataset, model, path, length): the files under base whose names match, as the file system has them; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(base).select("path", "length")
    at = F.split("path", "/")
    return files.select(F.element_at(at, -3).alias("dataset"), F.element_at(at, -2).alias("model"), "path", "length")


def first_rows(df: DataFrame, index: str, n: int) -> DataFrame:
    """The first n rows by index; each task keeps n at most before they meet."""
    return df.orderBy(index).limit(max(0, n))


def read_utility_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of many utility files, one JSON object each: metadata beside every data point, and the file's name."""
    points = "array<struct<index:long,num_steps:long,score:double,extracted_answer:string,grading_error:string,ran_second_pass:boolean>>"
    files = spark.read.schema(f"metadata struct<student_model:string,teacher_model:string,dataset_name:string>, data {points}").option("multiLine", True).json(pattern)
    rows = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("metadata.student_model").alias("student_model"), F.col("metadata.teacher_model").alias("teacher_model"), F.col("metadata.dataset_name").alias("dataset"), F.explode("data").alias("d"))
    return rows.select("file", "student_model", "teacher_model", "dataset", "d.index", "d.num_steps", "d.score", "d.extracted_answer", "d.grading_error", F.coalesce("d.ran_second_pass", F.lit(False)).alias("ran_second_pass"))


def read_reward_files(spark: SparkSession, base: str) -> DataFrame:
    """(dataset, model, trace_index, rm, reward): base/<dataset>/<model>/reward_model_<rm>.json, a mean for rows that repeat a key."""
    points = "array<struct<index:string,reward:double,rm_reward:double,score:double,rewards_by_model:map<string,double>>>"
    files = spark.read.schema(f"data {points}").option("multiLine", True).json(f"{base}/*/*/reward_model_*.json")
    at = F.split(F.input_file_name(), "/")
    rm = F.regexp_replace(F.element_at(at, -1), r"^reward_model_|\.json$", "")
    rows = files.select(F.lower(F.element_at(at, -3)).alias("dataset"), canonical_model(F.element_at(at, -2)).alias("model"), F.concat(F.lit("rm::"), rm).alias("rm"), F.explode("data").alias("d"))
    flat = rows.select("dataset", "model", F.col("d.index").try_cast("long").alias("trace_index"), "rm", "d.reward", "d.rm_reward", "d.score", "d.rewards_by_model").where("trace_index is not null")
    return flat.groupBy("dataset", "model", "trace_index", "rm").agg(F.avg(reward_of_row()).alias("reward"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of a results file that is a list, or an object with a list of results; anything else has none.

    (index, backtracking_detected, final_answer, backtracking_steps, confidence, overall_reasoning, error, prompt_tokens, output_tokens,
    total_tokens, finish_reason); a missing index is -1.
    """
    whole = spark.read.option("wholetext", True).text(path)
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.results"), "array<string>"))
    rows = whole.select(F.explode(items).alias("item")).where(F.col("item").startswith("{"))
    more = F.from_json("item", "index string, error string, prompt_tokens long, output_tokens long, total_tokens long, finish_reason string")
    got = rows.select(verdict("item").alias("v"), more.alias("m"))
    return got.select(F.coalesce(F.col("m.index").try_cast("long"), F.lit(-1)).alias("index"), "v.backtracking_detected", "v.final_answer", "v.backtracking_steps", "v.confidence", "v.overall_reasoning", *[f"m.{c}" for c in ("error", "prompt_tokens", "output_tokens", "total_tokens", "finish_reason")])


def read_pickles(spark: SparkSession, base: str, pattern: str = "*.pkl") -> DataFrame:
    """(path, dataset, model, file, size, field, index, value): what the pickles under base hold, item by item; see sources.pickles."""
    from tracemill.sources.pickles import register

    return register(spark).read.format("tracemill_artifacts").option("pattern", pattern).load(base)


def pickled_utility(spark: SparkSession, base: str) -> DataFrame:
    """Rows of all pu_*.pkl under base/<dataset>/<teacher>/: the metadata of their file beside every data point."""
    read = lambda field: read_pickles(spark, base, "pu_*.pkl").where(F.col("field") == field)
    point = "index long, num_steps long, score double, extracted_answer string, grading_error string, ran_second_pass boolean, student_model string"
    # two scans of the same files, each passing on one field: the metadata is a row for each file
    told = read("metadata").select("path", F.from_json("value", "student_model string, teacher_model string, dataset_name string").alias("m"))
    data = read("data").select("path", "file", F.from_json("value", point).alias("d"))
    rows = data.join(told, "path", "left")
    return rows.select("file", F.coalesce("d.student_model", "m.student_model").alias("student_model"), "m.teacher_model", F.col("m.dataset_name").alias("dataset"), "d.index", "d.num_steps", "d.score", "d.extracted_answer", "d.grading_error", F.coalesce("d.ran_second_pass", F.lit(False)).alias("ran_second_pass"))


def pickled_traces(spark: SparkSession, base: str, columns: dict[str, str]) -> DataFrame:
    """Rows of all traces_*.pkl under base/<dataset>/: columnar lists put side by side by their place in the file.

    columns names the lists and their Spark types. (dataset, model, place, columns); a list that is shorter leaves nulls.
    """
    held = read_pickles(spark, base, "traces_*.pkl").where(F.col("field").isin(*columns) & F.col("index").isNotNull())
    wide = held.groupBy("path", "dataset", "model", F.col("index").alias("place")).pivot("field", list(columns)).agg(F.first("value"))
    read = lambda c, kind: F.from_json(F.concat(F.lit('{"v":'), F.col(f"`{c}`"), F.lit("}")), f"v {kind}")["v"].alias(c)
    return wide.select("dataset", F.col("model"), "place", *[read(c, k) for c, k in columns.items()])


def pickled_rewards(spark: SparkSession, base: str) -> DataFrame:
    """(dataset, model, trace_index, rm, reward) of base/<dataset>/<model>/reward_model_<rm>.pkl, a mean for rows that repeat a key."""
    point = "index string, reward double, rm_reward double, score double, rewards_by_model map<string,double>"
    held = read_pickles(spark, base, "reward_model_*.pkl").where("field = 'data'")
    rm = F.concat(F.lit("rm::"), F.regexp_replace("file", r"^reward_model_|(\.part-\w+)?\.pkl$", ""))
    rows = held.select(F.lower("dataset").alias("dataset"), canonical_model("model").alias("model"), rm.alias("rm"), F.from_json("value", point).alias("d"))
    flat = rows.select("dataset", "model", F.col("d.index").try_cast("long").alias("trace_index"), "rm", "d.reward", "d.rm_reward", "d.score", "d.rewards_by_model").where("trace_index is not null")
    return flat.groupBy("dataset", "model", "trace_index", "rm").agg(F.avg(reward_of_row()).alias("reward"))


def write_pickles(df: DataFrame, base: str, prefix: str, layout: str = "rows", rows_per_file: int = 2000) -> None:
    """Rows (dataset, model, …) as pickles under base, split by dataset and model; see sources.pickles."""
    from tracemill.sources.pickles import register

    register(df.sparkSession)
    df.write.format("tracemill_artifacts").mode("append").option("prefix", prefix).option("layout", layout).option("rows_per_file", rows_per_file).save(base)
