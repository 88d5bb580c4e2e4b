"""Periodic runs against brute force and in linear time; resampling against a plain count."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import periodic, resampling
from tracemill.llm.queries import op12_position_ngrams, op13_periodic_runs, with_repeats


def all_runs(w, least):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j - i >= q and length >= least:
                seg = w[i : i + length]
                if not any(all(seg[k] == seg[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(2500):
        n, k = rng.randrange(70), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 5, 12])
        assert periodic.runs_of(w, least) == all_runs(w, least)
        zones = periodic._zones(np.array(w, dtype=np.int64), np.array([0, n]), 12)
        assert all(any(a <= s and s + length <= b for a, b in zones) for s, length, _ in all_runs(w, 12))


@pytest.mark.parametrize("kind", ["fibonacci", "one word", "thue-morse", "long period", "falling", "blocks"])
def test_comparisons_grow_with_the_text(kind):
    def text(n):
        if kind == "fibonacci":
            f, g = [0], [0, 1]
            while len(g) < n:
                f, g = g, g + f
            return g[:n]
        return {"one word": [0] * n, "thue-morse": [bin(i).count("1") % 2 for i in range(n)], "long period": [i % 700 for i in range(n)], "falling": [-i % 700 for i in range(n)], "blocks": [0 if i % 51 else i % 2 + 1 for i in range(n)]}[kind]

    for n in (5000, 40000):
        w = text(n)
        assert periodic._edges([*w, -1], 12, set()) <= 8 * n
        assert periodic._edges([*(1000 - c for c in w), -1], 12, set()) <= 8 * n


def test_collapse_of_odd_rows(spark):
    rep = "a b c d e f "
    texts = [None, "", " \n\t ", "one", rep * 2, rep * 2 + "a", ("x " * 11).strip(), "x " * 12, "u " + rep * 3 + "v", "y " * 30000, " a\x1cb " * 20, rep * 2]
    docs = spark.createDataFrame([(i, t, "keep", 1) for i, t in enumerate(texts)], "doc_id long, text string, `odd name` string, runs int")
    got = {r.doc_id: r for r in periodic.collapse(docs).collect()}
    assert got[0].asDict().keys() == {"doc_id", "odd name", "runs", "collapsed"}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = all_runs(w, 12) if i != 9 else [(0, 30000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [(r.start, r.length, r.period) for r in got[i].runs] == runs
        assert got[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert periodic.collapse(docs.where("doc_id < 0")).collect() == []


def test_many_texts_in_one_pass(spark):
    """Texts of one pass keep their own words, also where a run ends one text and begins the next."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in periodic.collapse(docs).collect():
        assert [(x.start, x.length, x.period) for x in r.runs] == all_runs(texts[r.doc_id].split(), 12)


def test_repeats_are_those_of_the_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, text) for i in range(200)] + [(None, text), (7, None), (8, "")], "doc_id long, text string")
    seen = 0
    for r in with_repeats(docs).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not r.text:
            continue
        seen, w, g = seen + 1, text.split(), h // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert r.text.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(50)]
    assert seen > 5


def plain_resample(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    grams = lambda t: [zlib.crc32(x.encode()) % 10000 for w in [words(t)] for x in [*w, *map(" ".join, zip(w, w[1:]))]]
    s, t = Counter(x for _, d in docs for x in grams(d)), Counter(x for d in target for x in grams(d))
    ss, tt = s.total(), t.total()
    rows = []
    for k, d in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in grams(d)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d))])
    can = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    place = {r[0]: i + 1 for i, r in enumerate(can[: 25 * len(can) // 100])}
    return sorted((*r[:4], place.get(r[0])) for r in rows)


def test_resample_against_plain_counts(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["Äpfel", "no", "YES", "x1", "über,all", "Éa"]) for _ in range(n))
    docs = [(i, rng.choice([None, "", "!!", say(19), say(20), say(30), say(300)])) for i in range(160)]
    target = [say(40), None, "", say(5)]
    frame = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, score int")
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_resample(docs, target)


def test_resample_repeated_null_and_no_rows(spark):
    text = " ".join(f"w{i % 7}" for i in range(25))
    docs = spark.createDataFrame([(5, text)] * 60 + [(None, text)] * 4 + [(6, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    rows = resampling.resample(docs, none).collect()
    assert len(rows) == 65 and sorted(r.rank for r in rows if r.rank) == list(range(1, 17))
    assert {r.n_features for r in rows if r.doc_id == 5} == {49}
    assert resampling.resample(docs.limit(0), none).collect() == []


def test_three_orders(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in resampling.resample(docs, docs.select("text"), orders=3).collect()}
    assert got == {1: 9, 2: 1}


def test_queries_return_every_row(spark):
    base = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{base}/documents.parquet").count()
    for q, columns in ((op12_position_ngrams, ["doc_id", "n_features", "weight", "score", "rank"]), (op13_periodic_runs, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])):
        df = q(spark, base)
        assert df.columns == columns and df.count() == n
        assert all(t in ("bigint", "string") for _, t in df.dtypes)
    assert op13_periodic_runs(spark, base).where(F.col("n_runs") > 0).count() > 0
