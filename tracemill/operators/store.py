"""Upserts, incremental loads and shard unions on Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(existing: DataFrame, arrivals: DataFrame, key: list[str], seq: str = "load_seq") -> DataFrame:
    """One row for each key: the one with the largest seq replaces the whole row before it."""
    w = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    return existing.unionByName(arrivals).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def only_new(arrivals: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Arrivals whose key has no row yet."""
    return arrivals.join(existing.select(*key).distinct(), key, "left_anti")


def shard(df: DataFrame, index: str, n: int, k: int, total: int | None = None) -> DataFrame:
    """Shard k of n: every n-th row, or with a total, contiguous blocks."""
    if total is None:
        return df.where(F.pmod(F.col(index), F.lit(n)) == k)
    size = -(-total // n)
    return df.where((F.col(index) >= k * size) & (F.col(index) < (k + 1) * size))


def union_shards(shards: list[DataFrame], meta: list[str], index: str) -> DataFrame:
    """All shards in order of index; raises if they disagree on a metadata column."""
    return checked_union(shards, meta).orderBy(index)


def checked_union(shards: list[DataFrame], meta: list[str]) -> DataFrame:
    """All shards, in no order; raises if they disagree on a metadata column."""
    out = reduce(lambda a, b: a.unionByName(b), shards)
    kinds = out.agg(*[F.count_distinct(c).alias(c) for c in meta]).first()
    if any(v > 1 for v in kinds):
        raise ValueError("shards have different metadata")
    return out


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """Parquet by partition columns, each partition's files sorted, so that min and max prune."""
    df.repartition(*by).sortWithinPartitions(*by, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_requests(df: DataFrame, path: str, columns: list[str]) -> None:
    """Line-delimited JSON requests."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, index: str, size: int = 100) -> None:
    """JSON chunks of neighbouring rows."""
    df.withColumn("chunk", F.floor(F.col(index) / size)).repartition("chunk").sortWithinPartitions("chunk", index).write.mode("overwrite").partitionBy("chunk").json(path)


def write_versioned(df: DataFrame, base: str, version: str) -> str:
    """Write a new version beside those of before, which stay; raises if the version is there. Returns its path."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def export(df: DataFrame, path: str) -> None:
    """One export as CSV with a header and as line-delimited JSON, nulls kept in both."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/csv")
    df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")


def write_detail_chunks(df: DataFrame, path: str, index: str, steps: str, size: int = 100, longest: int = 10) -> None:
    """Chunks of neighbouring rows; lists of more than longest steps go to a table of their own, by index."""
    far = F.size(steps) > longest
    df.where(far).select(index, steps).write.mode("overwrite").json(f"{path}/detail")
    write_chunks(df.withColumn("has_per_step", F.coalesce(F.size(steps) > 0, F.lit(False))).withColumn(steps, F.when(~far, F.col(steps))), f"{path}/chunks", index, size)


def sanitised(x) -> Column:
    """Bytes as text, with a mark in place of what is not UTF-8."""
    raw = (F.col(x) if isinstance(x, str) else x).cast("binary")
    return F.make_valid_utf8(raw.cast("string"))
