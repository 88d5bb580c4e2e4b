"""Reading tables, and the fixture views that stand in for trace artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def explode_columnar(df: DataFrame, columns: list[str], index: str = "index") -> DataFrame:
    """A columnar artifact (parallel lists in one row) as rows, with the position as index."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.posexplode(zipped).alias(index, "_r")).select(*kept, index, *[F.col("_r")[c].alias(c) for c in columns])


def read_json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited batch results; rows that don't parse have nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def traces(spark: SparkSession, base: str) -> DataFrame:
    d, l = read_table(spark, base, "documents"), read_table(spark, base, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("lang").alias("dataset"), F.col("source").alias("model"), F.col("doc_id").alias("trace_index"), F.col("text").alias("trace_text"), "n_chars", F.col("quality").cast("double").alias("score")
    )


def efficiency(spark: SparkSession, base: str) -> DataFrame:
    """Token and sentence counts of each trace."""
    from tracemill.functions import text as T

    d = read_table(spark, base, "documents")
    return d.select(F.col("lang").alias("dataset"), F.col("source").alias("model"), F.col("doc_id").alias("trace_index"), T.count_tokens("text").alias("token_count"), T.count_sentences("text").alias("sentence_count"))


def redundancy_scores(spark: SparkSession, base: str) -> DataFrame:
    """A stand-in score for each trace, absent for some, so that left joins matter."""
    d = read_table(spark, base, "documents").where("doc_id % 7 <> 0")
    return d.select(F.col("lang").alias("dataset"), F.col("source").alias("model"), F.col("doc_id").alias("trace_index"), (F.col("n_chars") % 50 / 50.0).alias("redundancy_score"))


def backtracking(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("n_chars")
    return read_table(spark, base, "documents").where("doc_id % 11 <> 0").select(
        F.col("lang").alias("dataset"),
        F.col("source").alias("model"),
        F.col("doc_id").alias("trace_index"),
        F.when(n % 7 > 2, 1).otherwise(0).alias("backtracking_detected"),
        (n % 7).alias("num_backtracking_steps"),
        F.when(n % 13 == 0, F.lit(None)).otherwise((n % 101) / 100.0).cast("double").alias("confidence"),
        F.when(n % 17 == 0, "parse error").alias("error"),
    )


def pu_records(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "events")
    by = Window.partitionBy("user_id", F.col("event_id") % 2)
    dataset = F.when(F.col("user_id") % 3 == 0, "math").when(F.col("user_id") % 3 == 1, "gpqa").otherwise("connections")
    steps = e.select(
        dataset.alias("dataset"),
        F.concat(F.lit("t"), (F.floor(F.col("user_id") / 3) % 2).cast("int").cast("string")).alias("teacher_model"),
        F.concat(F.lit("s"), (F.col("event_id") % 2).cast("int").cast("string")).alias("student_model"),
        F.col("user_id").alias("trace_index"),
        "value",
        (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("long").alias("num_steps"),
        F.count("*").over(by).alias("total_steps"),
        F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(1.0).alias("teacher_score"),
    )
    score = F.when(F.col("dataset") == "connections", F.least(F.lit(4.0), F.floor(F.col("value") / 40).cast("double"))).otherwise(F.when(F.col("value") > 60, 1.0).otherwise(0.0))
    return steps.select(
        "dataset", "teacher_model", "student_model", "trace_index", "num_steps", "total_steps", (F.col("num_steps").cast("double") / F.col("total_steps") * 100).alias("percentage_complete"), score.alias("score"), "teacher_score"
    )


def rewards(spark: SparkSession, base: str) -> DataFrame:
    """Two reward models in long form: (dataset, model, trace_index, rm, reward)."""
    c = read_table(spark, base, "customer")
    key = F.col("c_custkey")
    one = c.select(F.when(key % 3 == 0, "math").when(key % 3 == 1, "gpqa").otherwise("connections").alias("dataset"), F.concat(F.lit("t"), (F.floor(key / 3) % 2).cast("int").cast("string")).alias("model"), key.alias("trace_index"), F.lit("rm_a").alias("rm"), F.col("c_acctbal").alias("reward"))
    two = one.select("dataset", "model", "trace_index", F.lit("rm_b").alias("rm"), (F.col("reward") * -0.5 + F.col("trace_index")).alias("reward"))
    return one.unionByName(two)


def steps(spark: SparkSession, base: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return read_table(spark, base, "embeddings").select(F.col("label").cast("long").alias("trace_index"), "vec_id", "embedding", (F.row_number().over(w) - 1).cast("long").alias("step"))
