"""Folders for data that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; deleted when the driver ends.

    Where the session names none, a temporary folder stands in, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/tracemill-data"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written once and read as often as it is named: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
