"""Versions of a table: untouched partitions keep their files, and killed or late writes leave nothing visible."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import store, versions

SCHEMA = "dataset string, model string, trace_index long, score double, load_seq int"
KEY = ["dataset", "model", "trace_index"]


def files(base, name):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{base}/data/*/dataset={name}/*.parquet")}


def test_upserts_touch_their_partitions_alone(spark, tmp_path):
    base = str(tmp_path / "t")
    table = versions.VersionedTable(spark, base, KEY, ["dataset"])
    assert table.read() is None and table.versions() == []
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.write(rows(("a", "m", 1, 0.5, 1), ("b", "m", 1, 0.5, 1), (None, "m", 1, 9.0, 1))) == 1
    before = files(base, "b")
    assert table.write(rows(("a", "m", 1, 0.7, 2), ("a", "m", 2, 0.1, 1), ("c", "m", 1, 0.2, 1))) == 2
    assert files(base, "b") == before and len(files(base, "a")) >= 2
    want = {("a", "m", 1, 0.7, 2), ("a", "m", 2, 0.1, 1), ("b", "m", 1, 0.5, 1), ("c", "m", 1, 0.2, 1), (None, "m", 1, 9.0, 1)}
    assert {tuple(r[c] for c in [*KEY, "score", "load_seq"]) for r in table.read().collect()} == want
    assert table.read(1).count() == 3 and table.read(7) is None
    assert table.write(rows((None, "m", 1, 1.0, 2))) == 3 and table.read().where("dataset is null").first().score == 1.0
    # an older row does not replace a newer one, and new keys alone can be asked for
    table.write(rows(("a", "m", 1, 0.0, 0)))
    assert table.read().where("dataset = 'a' and trace_index = 1").first().score == 0.7
    table.write(rows(("a", "m", 1, 5.0, 9), ("a", "m", 3, 5.0, 9)), lambda old, new: old.unionByName(store.only_new(new, old, KEY)))
    assert {r.trace_index: r.score for r in table.read().where("dataset = 'a'").collect()} == {1: 0.7, 2: 0.1, 3: 5.0}


def test_killed_and_late_writes(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    table = versions.VersionedTable(spark, base, KEY, ["dataset"])
    one = spark.createDataFrame([("a", "m", i, 0.5, 1) for i in range(20)], SCHEMA)
    table.write(one)
    with pytest.raises(Exception, match="killed"):  # while data are written
        table.write(one, lambda old, new: new.withColumn("score", F.raise_error(F.lit("killed")).cast("double")))
    with monkeypatch.context() as m:  # after the data, before the manifest
        m.setattr(versions.VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.write(one.withColumn("score", F.lit(3.0)).withColumn("load_seq", F.lit(5)))
    assert table.versions() == [1] and {r.score for r in table.read().collect()} == {0.5}
    late = versions.VersionedTable(spark, base, KEY, ["dataset"])

    def beside(old, new):  # another writer is done while this one merges
        table.write(one.withColumn("score", F.lit(7.0)).withColumn("load_seq", F.lit(2)))
        return new

    with pytest.raises(versions.Conflict):
        late.write(one.withColumn("score", F.lit(8.0)), beside)
    assert {r.score for r in table.read().collect()} == {7.0}
    gone = table.clean(keep=1)
    assert gone and {r.score for r in table.read().collect()} == {7.0} and len(table.versions()) == 1


def test_newest_complete_version(spark, tmp_path):
    base = str(tmp_path / "v")
    assert versions.read_newest(spark, base) is None
    for n in ("1", "2", "3"):
        store.write_versioned(spark.range(int(n)), base, n)
    os.remove(f"{base}/version=3/_SUCCESS")
    assert versions.read_newest(spark, base).count() == 2
