"""Generation parameters of models out of a tree of config files: a model's own file or a default by size, then a dataset's overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.text import default_config, let

SECTIONS = ("sampling_params", "vllm_kwargs")
_SECTION = ", ".join(f"{s}:map<string,string>" for s in SECTIONS)
_BODY = f"struct<{_SECTION},dataset_overrides:map<string,struct<{_SECTION}>>>"


def merged(base, over) -> Column:
    """A map with the entries of another laid over it; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, none) for x in (base, over))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda m: F.map_concat(F.map_filter(m["a"], lambda k, _: ~F.map_contains_key(m["b"], k)), m["b"]))


def read_tree(spark: SparkSession, base: str) -> DataFrame:
    """(name, body): every <name>.json under base; a file is one value, as a config is small."""
    files = spark.read.option("wholetext", True).text(f"{base}/*.json").withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return files.select("name", F.col("value").alias("body"))


def resolve(models: DataFrame, configs: DataFrame) -> DataFrame:
    """models (model, dataset, anything else) with config, sampling_params and vllm_kwargs.

    configs is (name, body), body a JSON object of sections and dataset_overrides. A model's own config has its name in lower case
    with "--" for a slash; without one, the default that its size asks for counts. Values are text as JSON has them. A model for which
    there is neither, and a body that is no JSON, give empty maps; config is then null, or the name of that config.
    """
    known = configs.select(F.col("name").alias("_name"), F.from_json("body", _BODY).alias("_c"), F.lit(True).alias("_there"))
    own = F.replace(F.lower("model"), F.lit("/"), F.lit("--"))
    first = models.withColumn("_own", own).withColumn("_default", default_config("model"))
    one = first.join(known.select(F.col("_name").alias("_own"), F.col("_c").alias("_a"), F.col("_there").alias("_has")), "_own", "left")
    two = one.join(known.select(F.col("_name").alias("_default"), F.col("_c").alias("_b"), F.col("_there").alias("_falls")), "_default", "left")
    c = F.when(F.col("_has"), F.col("_a")).otherwise(F.col("_b"))
    name = F.when(F.col("_has"), F.col("_own")).when(F.col("_falls"), F.col("_default"))
    over = F.try_element_at(c["dataset_overrides"], F.col("dataset"))
    return two.select(*models.columns, name.alias("config"), *[merged(c[s], over[s]).alias(s) for s in SECTIONS])
