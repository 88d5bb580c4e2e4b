"""The reader of pickles: plain data only, item by item, and the data source over generated trees."""

import io
import os
import pickle

import pytest
from pyspark.sql import functions as F

from tracemill.sources import artifacts, pickles


def read(data: bytes):
    return list(pickles.items(lambda: io.BufferedReader(io.BytesIO(data))))


@pytest.mark.parametrize("protocol", range(0, 6))
def test_items_equal_those_of_the_object(protocol):
    shared = {"x": [1, 2]}
    top = {
        "metadata": {"a": 1, "t": (1, 2.5, None), "n": -(2**70)}, "data": [{"index": i, "text": "é" * i, "ok": i % 2 == 0, "deep": [[i], {"k": [i]}]} for i in range(2500)], "none": [], "one": [5], "set": [frozenset("ab")],
        "again": [shared, shared, "s", "s"], "raw": [b"\xff\x00"], "number": 3.5, "empty": {}, "list of lists": [[1], [2, [3]]],
    }
    got = read(pickle.dumps(top, protocol=protocol)) if protocol >= 4 else read(pickle.dumps({k: v for k, v in top.items() if k not in ("set", "raw")}, protocol=protocol))
    back = {}
    for field, index, value in got:
        if index is None:
            back[field] = value
        else:
            assert index == len(back.setdefault(field, []))
            back[field].append(value)
    assert back == {k: v for k, v in top.items() if v != [] and (protocol >= 4 or k not in ("set", "raw"))}


def test_top_lists_and_single_entries():
    assert read(pickle.dumps([{"a": 1}, 2])) == [("", 0, {"a": 1}), ("", 1, 2)]
    assert read(pickle.dumps({"data": [7]})) == [("data", 0, 7)]
    assert read(pickle.dumps("text")) == [("", None, "text")] and read(pickle.dumps({})) == []


def test_nothing_is_called_and_cut_files_are_told():
    class Bad:
        def __reduce__(self):
            return os.getpid, ()

    import datetime

    for v in ({"data": [Bad()]}, {"data": [datetime.date(2020, 1, 1)]}):
        with pytest.raises(ValueError, match="more than plain data"):
            read(pickle.dumps(v))
    with pytest.raises(ValueError):
        read(pickle.dumps({"data": list(range(1000))})[:-40])


def test_only_what_is_read_again_is_kept():
    data = pickle.dumps({"data": [{"text": str(i) * 50} for i in range(3000)]})
    kept = pickles._referred(io.BufferedReader(io.BytesIO(data)))
    assert len(kept) < 5  # the key's name, not the texts


def test_trees_of_files_as_tables(spark, tmp_path):
    base = str(tmp_path / "pu")
    rows = [(d, m, i, 3 * i, float(i % 2), f"a{i}", f"s{i % 3}") for d in ("math", "gpqa") for m in ("org_A", "B") for i in range(230)]
    df = spark.createDataFrame(rows, "dataset string, model string, index long, num_steps long, score double, extracted_answer string, student_model string").repartition(3)
    artifacts.write_pickles(df, base, "pu_", rows_per_file=50)
    files = [os.path.join(d, f) for d, _, names in os.walk(base) for f in names]
    assert len(files) >= 16 and not any("/_" in f for f in files)
    assert pickle.load(open(files[0], "rb"))["data"]
    got = artifacts.pickled_utility(spark, base).select("dataset", "teacher_model", "index", "num_steps", "score", "extracted_answer", "student_model").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    one = artifacts.read_pickles(spark, base).where("dataset = 'math' and model in ('B')")
    assert one.select(F.count_distinct("path")).first()[0] == len([f for f in files if "/math/B/" in f])
    assert one.rdd.getNumPartitions() == len([f for f in files if "/math/B/" in f])  # the other files are no partitions
    assert artifacts.read_pickles(spark, str(tmp_path / "nothing")).count() == 0

    traces = df.select("dataset", "model", F.col("index").alias("ids"), F.concat(F.lit("text\n \""), "extracted_answer").alias("full_traces"), F.when(F.col("index") % 5 > 0, F.col("score")).alias("scores"))
    artifacts.write_pickles(traces, str(tmp_path / "t"), "traces_", "columns", rows_per_file=70)
    got = artifacts.pickled_traces(spark, str(tmp_path / "t"), {"ids": "long", "full_traces": "string", "scores": "double"})
    assert sorted(map(repr, got.drop("place").collect())) == sorted(map(repr, traces.collect()))


def test_reward_pickles(spark, tmp_path):
    place = tmp_path / "MATH" / "org_DeepSeek-R1-0528"
    place.mkdir(parents=True)
    data = [{"index": 1, "reward": 2.0}, {"index": "1", "rm_reward": 4.0}, {"index": 2, "rewards_by_model": {"a": float("nan"), "b": 7.0}}, {"index": None, "reward": 1.0}, {"index": 3}]
    (place / "reward_model_x.pkl").write_bytes(pickle.dumps({"data": data}))
    got = sorted(tuple(r) for r in artifacts.pickled_rewards(spark, str(tmp_path)).collect())
    key = ("math", "deepseek-ai_DeepSeek-R1-0528")
    assert got == [(*key, 1, "rm::x", 3.0), (*key, 2, "rm::x", 7.0), (*key, 3, "rm::x", None)]
