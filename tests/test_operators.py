"""Hand-worked values and metamorphic checks of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tracemill import schema
from tracemill.functions import text
from tracemill.operators import backtracking as bt, curves, pu, stats, store, traces as tr
from tracemill.sources import tables as src

PU = "dataset string, teacher_model string, student_model string, trace_index long, num_steps long, total_steps long, percentage_complete double, score double, teacher_score double"


def records(spark, scores, trace=0, dataset="math"):
    return spark.createDataFrame([(dataset, "t", "s", trace, 3 * i, 10, 30.0 * i, float(s), 1.0) for i, s in enumerate(scores)], PU)


@pytest.mark.parametrize("scores, edge, latched", [([0, 1, 0, 1], 1, 1), ([0, 1, 0, 0], 1, 2), ([0, 0, 0, 0], 0, 0), ([1, 1, 1, 0], 1, 1)])
def test_both_kinds_of_regression(spark, scores, edge, latched):
    df = records(spark, scores)
    assert pu.regressions(df).first()["total_regressions"] == edge
    assert pu.latched_regressions(df).first()["total_regressions"] == latched


def test_teacher_gate_and_null_scores(spark):
    df = records(spark, [0, 1]).withColumn("teacher_score", F.lit(None).cast("double"))
    assert pu.percentage_bins(df).count() == 0
    assert pu.overall(records(spark, [0, 1])).first()["j0_accuracy"] == 0.0


def test_connections_are_divided_once(spark):
    got = {r["bin_center"]: r["mean_correct"] for r in pu.percentage_bins(records(spark, [4, 2], dataset="connections")).collect()}
    assert got == {1: 1.0, 31: 0.5}


@pytest.mark.parametrize("n, want", [(0, [0]), (1, [0]), (2, [0, 1]), (3, [0, 2]), (4, [0, 3]), (5, [0, 3, 4])])
def test_prefix_points(spark, n, want):
    assert spark.range(1).select(text.prefix_points(F.lit(n), 3).alias("p")).first()["p"] == want


def test_text_counts(spark):
    df = spark.createDataFrame([("A. B! C?  d",), ("",), (None,), (" . ",)], "t string")
    got = [tuple(r) for r in df.select(text.count_sentences("t"), text.count_tokens("t")).collect()]
    assert got == [(4, 4), (0, 0), (0, 0), (0, 1)]


def test_completion_and_partial_trace(spark):
    df = spark.createDataFrame([("abcdef", 2), ("abcdef", 0)], "t string, k int")
    assert [r[0] for r in df.select(text.completion("t", "k")).collect()] == ["cdef", "abcdef"]
    one = spark.createDataFrame([("A. B. C.",)], "t string")
    assert [one.select(text.partial_trace("t", F.lit(j))).first()[0] for j in (0, 1, 2, 9)] == ["A. B. C.", "A", "A B", "A. B. C."][:1] + ["A", "A B", "A. B. C."]


def test_constant_series_have_no_correlation_and_zero_slope(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    r = df.agg(stats.pearson("x", "y").alias("r"), stats.slope("y", "x").alias("s"), stats.r_squared("y", "x").alias("r2"), stats.fit_mse("y", "x").alias("m")).first()
    assert tuple(r) == (None, 0.0, 0.0, 0.0)


def test_p_values_match_the_t_table(spark):
    # two-sided 5 % points of Student's t: 12.706 (1 degree of freedom), 2.228 (10), 1.984 (100)
    for df, t in ((1, 12.706), (10, 2.228), (100, 1.984)):
        r = t / math.sqrt(df + t * t)
        assert spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(df + 2))).first()[0] == pytest.approx(0.05, abs=2e-4)


def test_correlation_tail_in_closed_forms(spark):
    # one degree of freedom: 1 - 2 / pi * asin |r|; two: 1 - |r|; many: the normal tail
    for r in (0.001, 0.3, -0.7, 0.999):
        got = spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(3)), stats.correlation_p(F.lit(r), F.lit(4))).first()
        assert got[0] == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)), abs=1e-12)
        assert got[1] == pytest.approx(1 - abs(r), abs=1e-12)
    for t in (0.5, 1.2, 1.8, 3.0, 6.0):
        n = 10**9
        r = t / math.sqrt(n - 2 + t * t)
        assert spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(n))).first()[0] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-4)
    edge = spark.range(1).select(*[stats.correlation_p(F.lit(r).cast("double"), F.lit(n)) for r, n in ((1.0, 9), (-1.0, 9), (0.0, 9), (0.5, 2), (None, 9), (float("nan"), 9))]).first()
    assert tuple(edge) == (0.0, 0.0, 1.0, None, None, None)


def test_bootstrap_by_moments(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = 0.6 * x + rng.normal(size=400)
    rows = [("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))] + [(None, i, float(i), 5.0 - i) for i in range(6)] + [("few", i, float(i), 1.0) for i in range(4)] + [("flat", i, 1.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "d string, i long, x double, y double").repartition(3)
    got = {r["d"]: r for r in stats.bootstrap_ci(df, ["d"], "x", "y", ["i"], 1000).collect()}
    rs = [np.corrcoef(x[k], y[k])[0, 1] for k in (rng.integers(0, 400, 400) for _ in range(1000))]
    lo, hi = np.quantile(rs, [0.025, 0.975])
    assert got["a"]["n"] == 400 and got["a"]["lo"] == pytest.approx(lo, abs=0.02) and got["a"]["hi"] == pytest.approx(hi, abs=0.02)
    assert got[None]["lo"] == pytest.approx(-1) and got[None]["hi"] == pytest.approx(-1)
    assert got["few"]["n"] == 4 and got["few"]["lo"] is None and got["flat"]["n"] == 9 and got["flat"]["lo"] is None


def test_holm(spark):
    df = spark.createDataFrame([("g", 1, 0.01), ("g", 2, 0.04), ("g", 3, 0.03)], "g string, i int, p double")
    got = {r["i"]: round(r["p_holm"], 6) for r in stats.holm(df, "p", ["g"], ["i"]).collect()}
    assert got == {1: 0.03, 3: 0.06, 2: 0.06}


def test_bootstrap_is_repeatable_and_holds_r(spark):
    df = spark.createDataFrame([("d", i, float(i), float(i % 7) + i) for i in range(60)], "d string, i int, x double, y double")
    a = stats.bootstrap_ci(df, ["d"], "x", "y", ["i"], 200).first()
    b = stats.bootstrap_ci(df.repartition(5), ["d"], "x", "y", ["i"], 200).first()
    assert tuple(a) == tuple(b) and a["lo"] < df.corr("x", "y") < a["hi"]
    assert stats.bootstrap_ci(df.limit(4), ["d"], "x", "y", ["i"]).first()["lo"] is None


def test_an_exact_repeat_is_fully_redundant(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "trace_index long, step long, embedding array<float>")
    per = tr.redundancy_per_step(df)
    got = {(r["trace_index"], r["step"]): (r["best"], r["match"]) for r in per.collect()}
    assert got == {(1, 0): (0.0, -1), (1, 1): (0.0, 0), (1, 2): (1.0, 0), (2, 0): (0.0, -1)}
    assert {r["trace_index"]: r["redundancy_score"] for r in tr.redundancy_stats(per, 0.85).collect()} == {1: 0.5, 2: 0.0}


def test_merge_precedence(spark):
    cols = "dataset string, model string, trace_index long, k long, error string, batch_seq int"
    old = spark.createDataFrame([("d", "m", 1, 1, None, 1), ("d", "m", 2, 1, "e", 1), ("d", "m", 3, 1, None, 1)], cols)
    new = spark.createDataFrame([("d", "m", 1, 2, "e", 2), ("d", "m", 2, 2, "e2", 2), ("d", "m", 3, 2, None, 2), ("d", "m", 4, 2, "e", 2)], cols)
    got = {r["trace_index"]: (r["k"], r["error"]) for r in bt.merge(old, new).collect()}
    assert got == {1: (1, None), 2: (2, "e2"), 3: (2, None), 4: (2, "e")}
    again = bt.merge(bt.merge(old, new), new)
    assert {r["trace_index"]: (r["k"], r["error"]) for r in again.collect()} == got


def test_inflight_ranges_and_states(spark):
    df = spark.createDataFrame([("d", "m", [5], None, None, "running"), ("d", "m", None, 1, 4, None), ("d", "m", None, 7, 7, "pending"), ("d", "m", [9], None, None, "completed")], "dataset string, model string, indices array<long>, start_index long, end_index long, status string")
    assert sorted(r["trace_index"] for r in bt.inflight_keys(df).collect()) == [1, 2, 3, 5]


def test_shards_in_any_form_give_the_whole(spark):
    df = spark.range(103).select(F.col("id").alias("i"), F.lit("m").alias("meta"))
    for total in (None, 103):
        parts = [store.shard(df, "i", 4, k, total) for k in range(4)]
        assert [r["i"] for r in store.union_shards(parts, ["meta"], "i").collect()] == list(range(103))
    with pytest.raises(ValueError):
        store.union_shards([df, df.withColumn("meta", F.lit("n"))], ["meta"], "i")


def test_smoothing_keeps_constants_and_short_curves(spark):
    flat = spark.createDataFrame([("d", "m", float(i), 0.5) for i in range(5)] + [("d", "n", 0.0, 1.0), ("d", "n", 1.0, 0.0)], "dataset string, model string, x double, y double")
    got = {(r["model"], r["x"]): r["y"] for r in curves.smoothed(flat).collect()}
    assert all(abs(got["m", float(i)] - 0.5) < 1e-12 for i in range(5)) and got["n", 0.0] == 1.0 and got["n", 1.0] == 0.0


def test_columnar_artifacts_become_rows(spark):
    df = spark.createDataFrame([("m", ["q1", "q2"], [1.0, 0.0])], "model string, questions array<string>, scores array<double>")
    assert [tuple(r) for r in src.explode_columnar(df, ["questions", "scores"]).collect()] == [("m", 0, "q1", 1.0), ("m", 1, "q2", 0.0)]


def test_policies(spark):
    df = spark.createDataFrame([(0.4,), (1.0,), (None,)], "score double")
    assert [[r[0] for r in df.select(schema.correct("score", p)).collect()] for p in ("above_zero", "above_half", "equals_one")] == [[1.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]


def test_stream_collects_as_the_batch_does(spark, tmp_path):
    from tracemill.streaming.collector import collect_verdicts

    cols = "dataset string, model string, trace_index long, k long, error string, batch_seq int"
    rows = [("d", "m", 1, 1, "e", 1), ("d", "m", 1, 2, None, 2), ("d", "m", 2, 3, None, 2)]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    state = {"df": spark.createDataFrame([], cols)}

    def write(df, epoch):
        path = str(tmp_path / f"out{epoch}")
        df.write.mode("overwrite").parquet(path)
        state["df"] = spark.read.parquet(path)

    q = collect_verdicts(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), lambda: state["df"], write, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r["trace_index"], r["k"]) for r in state["df"].collect()} == {(1, 2), (2, 3)}


def test_written_partitions_prune(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("dataset"), "id")
    store.write_partitioned(df, str(tmp_path / "p"), ["dataset"], ["id"])
    got = spark.read.parquet(str(tmp_path / "p")).where("dataset = '1'")
    assert got.count() == 20 and "PartitionFilters: [isnotnull(dataset" in got._jdf.queryExecution().toString()
    store.write_requests(df, str(tmp_path / "r"), ["id"])
    assert spark.read.json(str(tmp_path / "r")).count() == 40


def test_condition_keys_and_presets():
    from tracemill.plans import serving

    assert serving.condition_key("all", "all", "all") == ("unconditional", "all")
    assert serving.condition_key("math", "m", "correct_only") == ("by_dataset_model__correct_only", "math::m")
    assert serving.condition_key("all", "m", "incorrect_only") == ("by_model__incorrect_only", "m")
    names = ["trace_score", "rm::a", "pu_x", "pu_linearity_mse", "eff_n"]
    assert serving.preset(names, "core") == ["trace_score", "rm::a", "pu_linearity_mse"]
    assert serving.preset(names, "rm_pu") == ["rm::a", "pu_x", "pu_linearity_mse"]
    with pytest.raises(ValueError):
        serving.preset(names, "none")


def test_connections_answers_in_the_shape_of_the_replies(spark):
    from tracemill.functions import text

    reply = '{"groupings":{"1":{"category":"fish","words":["cod","eel"]},"2":{"category":"b {}","words":["x"]}}}'
    want = {"FISH": ["COD", "EEL"], "B {}": ["X"]}
    rows = [
        (1, f"```json\n{{}}\n``` then ```JSON {reply} ```", want),
        (2, f"no fence {{ and }} {reply} after {{\"a\": 1}}", want),
        (3, '{"Groupings": {"1": {"category": "a", "words": ["q"]}}} or rather {"Groupings": {"1": {"category": "z", "words": ["r"]}}}', {"Z": ["R"]}),
        (4, f"{reply} ```json {{\"groupings\": {{\"1\": 3}}}}```", None),
        (5, "nothing { here", None),
        (6, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, output string")
    got = {r["id"]: r["a"] for r in df.select("id", text.connections_answer("output").alias("a")).collect()}
    assert got == {i: w for i, _, w in rows}


def test_normal_forms_of_answers(spark):
    want = {
        "1/2": "\\frac{1}{2}", "-3/4": "\\frac{-3}{4}", "\\sqrt12": "\\sqrt{12}", "\\frac1b": "\\frac{1}{b}", "\\dfrac{1}{2}": "\\frac{1}{2}", "\\frac3{4}": "\\frac{3}{4}", "\\frac": "\\frac", "a\\frac1": "a\\frac1",
        "\\begin{bmatrix}1\\end{bmatrix}": "\\begin{pmatrix}1\\end{pmatrix}", "\\begin{array}{cc}1\\end{array}": "\\begin{pmatrix}1\\end{pmatrix}", "x\\leq 3": "x\\le3", "inf": "\\infty", "-infinity": "-\\infty", "2j": "2i", "2ji": "2ji",
        "3,1,2": "1,2,3", "10, 9": "9,10", "007": "7", "1,234,567": "1234567", "1,234": "1234", "five": "5", "\\text{seven}": "7", "\\text{no}": "no", "12\\text{ cm}": "12", "(-\\infty,\\infty)": "\\mathbb{R}", "\\emptyset": "{}", ".5": "0.5", "3.": "3", "2.0x": "2x",
        "k=7": "7", "long=7": "long=7", "4 and 5": "45", "5\\mbox{ m}": "5", "\\mathbf{v}": "{v}", "90^{\\circ}": "90", "\\sqrt2/3": "\\frac{\\sqrt{2}}{3}", "5thgrade": "5", "": "", " ": "", "a/b": "a/b", "1/2/3": "1/2/3",
    }
    df = spark.createDataFrame([(k,) for k in [*want, None]], "a string")
    got = {r["a"]: r["n"] for r in df.select("a", text.normalise_answer("a").alias("n")).collect()}
    assert got == want | {None: None}


def test_grades_of_answers(spark):
    from tracemill.functions import grading

    m = lambda *rows: "\\begin{pmatrix}" + "\\\\".join(rows) + "\\end{pmatrix}"
    cases = [
        ("x=5", "5", 1), ("5", "y = 5", 1), ("xyz=5", "5", 0), ("x=5", "y=5", 0), (m("1 & 2", "3 & 4"), m("1&2.00", " 3& 4"), 1), (m("1 & 2"), m("1 & 3"), 0), (m("1", "2"), m("1 & 2"), 0), (m("1&2") + "x", m("1&2"), 0),
        ("(1,50%)", "(1, 0.5)", 1), ("(A,2)", "(a,2)", 1), ("[1,2]", "(1,2)", 1), ("(1,2)", "(2,1)", 0), ("[3]", "3", 1), ("{3}a", "3a", 1), ("50%", "0.5", 1), ("0.5", "50", 1), ("7", "8", 0), ("", "", 1), ("", "1", 0), (None, "1", 0), ("1", None, 0),
        (m("1\\2"), "{1,2}", 1), ("The choice is C.", "C", 1),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p string, t string")
    got = {r["i"]: r["g"] for r in df.select("i", grading.grade_math("p", "t").cast("int").alias("g")).collect()}
    assert [(cases[i], got[i]) for i in got if got[i] != cases[i][2]] == []


def test_artifact_files_become_rows(spark, tmp_path):
    import json

    from tracemill.sources import artifacts

    for k in (1, 2):
        points = [{"index": i, "num_steps": 3 * i, "score": 1.0, "extracted_answer": "a"} for i in range(k)]
        (tmp_path / f"pu_{k}.json").write_text(json.dumps({"metadata": {"student_model": "s", "teacher_model": f"t{k}", "dataset_name": "math"}, "data": points}))
    got = sorted(tuple(r) for r in artifacts.read_utility_files(spark, str(tmp_path / "pu_*.json")).select("file", "teacher_model", "index", "ran_second_pass").collect())
    assert got == [("pu_1.json", "t1", 0, False), ("pu_2.json", "t2", 0, False), ("pu_2.json", "t2", 1, False)]
    place = tmp_path / "rm" / "MATH" / "org_DeepSeek-R1-0528"
    place.mkdir(parents=True)
    rows = [{"index": 1, "reward": 2.0}, {"index": "1", "rm_reward": 4.0}, {"index": 2, "rewards_by_model": {"a": None, "b": 7.0}}, {"index": None, "reward": 1.0}, {"index": 3}]
    (place / "reward_model_x.json").write_text(json.dumps({"data": rows}))
    got = sorted(tuple(r) for r in artifacts.read_reward_files(spark, str(tmp_path / "rm")).collect())
    key = ("math", "deepseek-ai_DeepSeek-R1-0528")
    assert got == [(*key, 1, "rm::x", 3.0), (*key, 2, "rm::x", 7.0), (*key, 3, "rm::x", None)]
    for name, body in (("list", [{"index": 4, "confidence": 2}, "junk"]), ("dict", {"results": [{"final_answer": "q", "total_tokens": 9}]}), ("odd", {"other": 1}), ("bad", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body) if name != "bad" else "{not json")
    read = lambda n: [(r["index"], r["final_answer"], r["confidence"], r["total_tokens"]) for r in artifacts.read_results(spark, str(tmp_path / f"{n}.json")).collect()]
    assert read("list") == [(4, "", 1.0, None)] and read("dict") == [(-1, "q", 0.0, 9)] and read("odd") == read("bad") == []
    sidecar = tmp_path / "pool.json"
    sidecar.write_text('{"index": 3, "error": "e"}\n{"index": 4}\n')
    assert [tuple(r) for r in src.read_json_results(spark, str(sidecar), "index long, error string").orderBy("index").collect()] == [(3, "e"), (4, None)]


def test_exports_versions_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t {i}", [0.1] * i if i else None) for i in range(15)], "i long, t string, steps array<double>")
    store.export(df.select("i", "t"), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e" / "csv")).count() == spark.read.json(str(tmp_path / "e" / "json")).count() == 15
    path = store.write_versioned(df, str(tmp_path / "v"), "1")
    assert spark.read.parquet(path).count() == 15
    with pytest.raises(Exception, match="exists"):
        store.write_versioned(df, str(tmp_path / "v"), "1")
    store.write_detail_chunks(df, str(tmp_path / "c"), "i", "steps", size=4)
    assert {r["i"] for r in spark.read.json(str(tmp_path / "c" / "detail")).collect()} == {11, 12, 13, 14}
    chunks = spark.read.json(str(tmp_path / "c" / "chunks"))
    assert {r["chunk"] for r in chunks.collect()} == {0, 1, 2, 3} and {r["i"]: r["has_per_step"] for r in chunks.collect()}[0] is False
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xffb"),)], "b binary")
    assert [r[0] for r in raw.select(store.sanitised("b")).collect()] == ["ok", "a\ufffdb"]


def test_ranks_and_spearman_without_sorting_a_group(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": ["a"] * 4000 + ["b"] * 5, "x": rng.integers(0, 300, 4005).astype(float), "y": rng.normal(size=4005).round(1)})
    pdf.loc[:1500, "x"] = 7.0  # a value that a third of a group has
    got = {r["g"]: (r["n"], r["rho"]) for r in stats.spearman(spark.createDataFrame(pdf), ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g][0] == len(part) and got[g][1] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-9)


def test_models_families_and_optional_tables(spark):
    from tracemill.plans import serving

    names = spark.createDataFrame([("deepseek-Qwen",), ("QwQ-32B",), ("new",)], "n string")
    got = [r[0] for r in names.select(text.family("n")).collect()]
    assert got[:2] == ["deepseek", "qwq"] and got[2].startswith("slot ")
    rows = spark.createDataFrame([("d", 1)], "k string, v int")
    assert serving.with_optional(rows, None, ["k"]).columns == ["k", "v"]
    assert serving.with_optional(rows, rows, ["k"], "wl_").first()["wl_v"] == 1


def test_canonical_forms_at_every_depth(spark):
    from tracemill.functions import jsonparse

    rows = [({"b": {"y": [1, 2], "x": [3]}, "a": {}}, [{"k": 1}, {"j": 2, "k": 1}]), ({"a": {}, "b": {"x": [3], "y": [1, 2]}}, [{"k": 1, "j": 2}, {"k": 1}, {"k": 1}]), ({"b": {"y": [2, 1], "x": [3]}, "a": {}}, [{"k": 1}]), (None, None)]
    df = spark.createDataFrame(rows, "m map<string,map<string,array<int>>>, s array<map<string,int>>")
    got = df.select(jsonparse.canonical("m").alias("m"), jsonparse.canonical_set("s").alias("s")).collect()
    assert got[0].m == got[1].m == '{"a":{},"b":{"x":[3],"y":[1,2]}}' and got[2].m != got[0].m and got[3].m is None
    assert got[0].s == got[1].s and got[2].s == ['{"k":1}'] and got[3].s is None
    texts = spark.createDataFrame([('{"b": [ {"d":1,"c":2} ], "a":null}',), ("{",), (None,)], "t string")
    assert [r[0] for r in texts.select(jsonparse.canonical_json("t")).collect()] == ['{"a":null,"b":[{"c":2,"d":1}]}', None, None]


def test_teacher_scores_are_of_one_dataset_and_teacher(spark):
    rec = spark.createDataFrame([("math", "t0", 3), ("math", "t1", 3), ("gpqa", "t0", 3), ("math", "t0", 9)], "dataset string, teacher_model string, trace_index long")
    known = spark.createDataFrame([("math", "t0", 3, 0.0, 1), ("math", "t0", 3, 1.0, 2), ("gpqa", "t0", 3, 0.5, 1)], "dataset string, model string, trace_index long, score double, place int")
    got = pu.with_teacher_scores(rec, known, "place").collect()
    assert sorted((r.dataset, r.teacher_model, r.trace_index, r.teacher_score) for r in got) == [("gpqa", "t0", 3, 0.5), ("math", "t0", 3, 1.0), ("math", "t0", 9, None), ("math", "t1", 3, None)]


def test_answer_spans_are_places_of_the_match(spark):
    cases = {
        "the answer is \\boxed{5} or 5 apples, 5.": ("5", 21, 22), "x boxed": ("", -1, -1), "so \\boxed 7 $ then 7": ("7", 10, 11), "he answer is  12. The answer is 12.": ("12", 32, 35), "ANSWER: a ANSWER: b": ("b", 18, 19),
        "答案是 9\n\nmore 9": ("9", 4, 5), "1,234 and 5,678": ("678", 12, 15), "final answer is $ 3 $. I hope 3": ("3", 18, 19), "none": ("", -1, -1), "": ("", -1, -1), "\\boxed{\\frac{1}{2}}": ("\\frac{1}{2}", 7, 18), "final answer is\n 4": ("4", 17, 18), "киthe 5": ("5", 4, 5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: tuple(r.s) for r in df.select("t", text.answer_span("t").alias("s")).collect()}
    assert got == cases


def test_redundancy_by_blocks_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(t, s, [float(v) for v in rng.integers(-2, 3, 4)]) for t, n in ((1, 70), (2, 1), (3, 33)) for s in range(n)]
    got = {(r.trace_index, r.step): (r.best, r.match) for r in tr.redundancy_per_step(spark.createDataFrame(rows, "trace_index long, step long, embedding array<double>").repartition(5), 16).collect()}
    assert len(got) == len(rows)
    for t, s, v in rows:
        earlier = [(float(np.dot(v, w)), -p) for u, p, w in rows if u == t and p < s]
        want = max(earlier, default=(0.0, 1))
        assert got[t, s] == (want[0], -want[1])
