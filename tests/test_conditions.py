"""Correlations of all conditions against pandas, ranks and adjusted p-values with hot values, and the number of scans."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import stats
from tracemill.plans import serving


def table(n=900):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"dataset": rng.choice(["d1", "d2", None], n), "model": rng.choice(["m1", "m2", "m3"], n), "correct": rng.choice([True, False, None], n), "a": rng.integers(0, 20, n).astype(float), "b": rng.normal(1e6, 1, n).round(2), "c": 3.0})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    pdf["b"] += pdf["a"].fillna(0) / 10
    return pdf


def test_all_conditions_against_pandas(spark):
    pdf = table()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "dataset string, model string, correct boolean, a double, b double, c double")
    got = {(r.condition, r.grp, r.method, r.metric_x, r.metric_y): (r.n, r.r) for r in stats.condition_correlations(df, ["a", "b", "c"]).collect()}
    want = {}
    for family, kept in stats.FAMILIES.items():
        for suffix, ok in stats.SUFFIXES.items():
            part = pdf if ok is None else pdf[pdf["correct"] == ok]
            for group, rows in part.fillna({"dataset": "none"}).groupby(list(kept)) if kept else [((), part)]:
                pair = rows[["a", "b"]].dropna()
                if len(pair) >= 3:
                    for method in ("pearson", "spearman"):
                        want[family + suffix, "::".join(group) or "all", method, "a", "b"] = (len(pair), (pair if method == "pearson" else pair.rank())["a"].corr((pair if method == "pearson" else pair.rank())["b"]))
    assert set(got) == set(want) and len({k[0] for k in got}) == 12  # a constant has no correlation
    for k, (n, r) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-7)


def test_holm_with_equal_values_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0.01, 0.01, 0.02, rng.random()]) if i % 3 else 0.005) for g in ("x", None) for i in range(500)] + [("y", 1, 0.4), ("y", 2, None)]
    got = {(r.g, r.i): r.p_holm for r in stats.holm(spark.createDataFrame(rows, "g string, i int, p double"), "p", ["g"], ["i"]).collect()}
    assert len(got) == len(rows) and got["y", 1] == 0.4 and got["y", 2] is None
    for g in ("x", None):
        part, top = sorted(r for r in rows if r[0] == g and r[2] is not None) and sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 0.0
        for k, (_, i, p) in enumerate(part):
            top = max(top, min(1.0, p * (len(part) - k)))
            assert got[g, i] == pytest.approx(top)


def test_few_scans(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = stats.spearman(df, ["lang"], "n_chars", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= 4  # distinct pairs once, ranks twice


def test_served_rows(spark):
    rows = spark.createDataFrame([("by_dataset", "d", "rm::a", "pu_b", 0.5), ("by_dataset", "d", "eff_x", "pu_b", 0.5), ("by_model", "d", "rm::a", "pu_b", 0.5), ("by_dataset__correct_only", "d", "rm::a", "pu_b", 0.1)], "condition string, grp string, metric_x string, metric_y string, r double")
    got = serving.served_correlations(rows, "d", "all", "all", ["rm::a", "pu_b", "eff_x"], "rm_pu").collect()
    assert [(r.label_x, r.label_y, r.r) for r in got] == [("RM: a", "PU: b", 0.5)]
    assert serving.served_correlations(rows, "d", "all", "correct_only", ["rm::a", "pu_b"]).select(F.max("r")).first()[0] == 0.1
