"""A Parquet table with versions: an upsert rewrites the partitions that it touches, and one rename makes it visible.

base/data/v=N-<id>/<partitions>/ holds what the writer of version N wrote, base/manifests/N names the folder of each partition as of N. A manifest is
written aside and renamed, so a version is there as a whole or not at all; what a killed write leaves is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill.operators import store


class Conflict(Exception):
    """Another writer finished this version first; nothing of one's own became visible."""


class VersionedTable:
    """Rows with a key, partitioned by columns of it."""

    def __init__(self, spark: SparkSession, base: str, key: list[str], by: list[str]):
        self.spark, self.base, self.key, self.by = spark, base.rstrip("/"), key, by

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(int(n) for n in self._names(f"{self.base}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(by, path, schema): the folder of each partition as of a version, the newest by default; None before the first."""
        known = self.versions()
        if not known or version is not None and version not in known:
            return None
        return self.spark.read.parquet(f"{self.base}/manifests/{known[-1] if version is None else version}")

    def _read(self, entries: list) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entries[-1]["schema"]))
        with_version = T.StructType([*schema.fields, T.StructField("v", T.StringType())])
        return self.spark.read.schema(with_version).option("basePath", f"{self.base}/data").parquet(*[e["path"] for e in entries]).select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest complete one by default; None where there is none."""
        m = self.manifest(version)
        entries = [] if m is None else m.orderBy("path").collect()  # a row for each partition
        return self._read(entries) if entries else None

    def write(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Merge rows into the partitions that they touch, and make the result the newest version; returns its number.

        merge(existing, arrivals) gives the new rows of those partitions, by default the upsert by key and load_seq. Partitions
        that no row touches keep their files. Rows with a null in a partition column have a partition of their own.
        """
        merge = merge or (lambda old, new: store.upsert(old, new, self.key))
        before = self.versions()
        number = 1 + max([0, *before, *(int(n[2:].split("-")[0]) for n in self._names(f"{self.base}/data") if n.startswith("v="))])
        held = self.manifest()
        touched = rows.select(*self.by).distinct().collect()  # a row for each partition
        keys = {tuple(r) for r in touched}
        entries = [] if held is None else held.collect()
        mine, others = [e for e in entries if tuple(e[c] for c in self.by) in keys], [e for e in entries if tuple(e[c] for c in self.by) not in keys]
        old = self._read(mine) if mine else rows.limit(0)
        place = f"{self.base}/data/v={number}-{uuid.uuid4().hex[:12]}"
        # a partition is dealt to several tasks by the key's hash, so a hot one is no task of its own
        merge(old, rows).select(*rows.columns).write.mode("errorifexists").partitionBy(*self.by).parquet(place)
        schema = T.StructType([*[f for f in rows.schema.fields if f.name not in self.by], *[rows.schema[c] for c in self.by]])
        wrote = self.spark.read.schema(schema).parquet(place).select(*self.by, F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("path")).distinct()
        kept = self.spark.createDataFrame([tuple(e[c] for c in [*self.by, "path"]) for e in others], T.StructType([*[rows.schema[c] for c in self.by], T.StructField("path", T.StringType())]))
        self._publish(wrote.unionByName(kept).withColumn("schema", F.lit(schema.json())), number, before)
        return number

    def _publish(self, manifest: DataFrame, number: int, before: list[int]) -> None:
        aside = f"{self.base}/manifests/_{number}-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(aside)
        if self.versions() != before:
            raise Conflict(f"version {number} was built on {before[-1:]}, but there is {self.versions()[-1:]} now")
        (source, fs), (target, _) = self._path(aside), self._path(f"{self.base}/manifests/{number}")
        if not fs.rename(source, target):
            raise Conflict(f"version {number} is there already")

    def clean(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest `keep`, and all data that none of those names; returns the data folders deleted.

        Not to be run beside a writer, whose files no manifest names yet.
        """
        known = self.versions()
        for n in known[:-keep] if keep else known:
            p, fs = self._path(f"{self.base}/manifests/{n}")
            fs.delete(p, True)
        for n in self._names(f"{self.base}/manifests"):
            if n.startswith("_"):
                p, fs = self._path(f"{self.base}/manifests/{n}")
                fs.delete(p, True)
        used = {e["path"].split("/data/")[-1].split("/")[0] for n in self.versions() for e in self.manifest(n).collect()}
        gone = [n for n in self._names(f"{self.base}/data") if n not in used]
        for n in gone:
            p, fs = self._path(f"{self.base}/data/{n}")
            fs.delete(p, True)
        return gone


def read_newest(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest of store.write_versioned's versions whose write was completed, by name; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted((s.getPath().getName() for s in fs.listStatus(root)), reverse=True) if fs.exists(root) else []
    for n in names:
        if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS")):
            return spark.read.parquet(f"{base}/{n}")
    return None
