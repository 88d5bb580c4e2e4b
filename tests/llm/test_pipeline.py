import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracemill.llm import jaccard_join, language, pii, survivors

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    out = [docs]
    for _, f in cp.STAGES:
        df = f(spark, out[-1], DIR).cache()
        df.count()
        out.append(df)
    return out


def test_columns_and_rows(stages):
    docs = stages[0]
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    for a, b in zip(stages[:4], stages[1:5]):
        assert b.columns == docs.columns
        assert {r[0] for r in b.select("doc_id").collect()} <= {r[0] for r in a.select("doc_id").collect()}
    assert stages[4].count() == stages[3].count()


def test_near_duplicates_against_brute_force(stages):
    from tests.llm.test_jaccard_join import brute

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {d for d, _, c in brute(rows) if d == c}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_masking_and_packing_cover_what_is_left(stages):
    assert all(not pii.base_spans(r["text"] or "") for r in stages[4].collect())
    left = {r["doc_id"]: len((r["text"] or "").split()) for r in stages[4].collect()}
    got = {}
    for r in stages[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got.keys() == left.keys()
    ascii_white = {r["doc_id"]: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]) for r in stages[4].collect()}
    assert got == ascii_white


def test_clean_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert language.UNKNOWN not in {r["lang"] for r in stages[2].collect()}


def kept_by_hand(rows, brute):
    """Rows (id, text, more) that stay, by the rules of one_of_each, said directly."""
    import json
    import re

    group = {}
    named = [r for r in rows if r[0] is not None]
    group_of = [c for _, _, c in brute(list(enumerate(t for _, t, *_ in named)))]
    least = {g: min(r[0] for r, c in zip(named, group_of) if c == g) for g in set(group_of)}
    classes = lambda t: frozenset(zip(*[[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")][k:] for k in range(5)])) or tuple(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    component = {}
    for (i, t, *_), g in zip(named, group_of):
        component[i, classes(t)] = g
    wordless = [r for r in rows if not classes(r[1])]
    for r in rows:
        key = classes(r[1])
        if not key:
            continue
        if r[0] is None:
            if not any(k == key for _, k in component):
                group.setdefault((None, key), []).append(r)
        else:
            group.setdefault(component[r[0], key], []).append(r)
    out = list(wordless)
    for c, members in group.items():
        if isinstance(c, int):
            members = [m for m in members if m[0] == least[c]]
            size = lambda m: len(classes(m[1])) if isinstance(classes(m[1]), frozenset) else 1
            members = [m for m in members if size(m) == min(map(size, members))]
        out.append(min(members, key=lambda m: (m[1], json.dumps(m))))
    return out


def test_one_row_of_each_group_stays(spark):
    from tests.llm.test_jaccard_join import brute

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, rng.choice(texts), 1) for i in range(140)]
    rows += [(5, texts[0] + "  ", 2), (5, "unique words that no other row of the table has", 2), (9, "unique words that no other row of the table has", 3), (5, "all of it differs from the rest of them here", 2)]
    rows += [(7, texts[1], 5)] * 4 + [(200, "some more words of a row of its own", 1)] * 3 + [(201, "", 1), (201, " ", 2), (202, None, 1), (202, None, 1)]
    rows += [(None, texts[2], 1), (None, "nobody else says these words at all", 1), (None, "nobody else says these words at all", 1), (None, "", 4)]
    cols = "doc_id long, text string, _slot int"
    docs = spark.createDataFrame(rows, cols).withColumn("component_id", F.lit(-1)).withColumn("rep", F.lit("r"))
    got = [tuple(r)[:3] for r in survivors.one_of_each(docs.repartition(3), jaccard_join.near_duplicates(docs)).collect()]
    want = kept_by_hand(rows, brute)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {t for i, t, _ in got if i == 5} >= {"unique words that no other row of the table has", "all of it differs from the rest of them here"}
    # the example of clashing ids: each text once
    few = spark.createDataFrame([(3, "a a a a a a"), (5, "a a a a a a"), (5, "b c d e f g"), (9, "b c d e f g")], "doc_id long, text string")
    assert sorted(map(tuple, survivors.one_of_each(few, jaccard_join.near_duplicates(few)).collect())) == [(3, "a a a a a a"), (5, "b c d e f g")]


def odd_table(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "and", "ing", "er", "th", "on", "re", "tion"]) + rng.choice(["the", "ed", "er", "ing", "s"])
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(rng.randrange(20, 90)), "en", "src1") for i in range(80)]
    rows += [(80, prose(60_000), "en", None), (81, None, "en", "s"), (82, "", None, "s"), (83, "  ", "fr", "s"), (None, prose(30), "en", "s"), (None, None, None, None)]
    rows += [rows[4]] * 3 + [(4, prose(50), "en", "src2"), (90, rows[4][1], "en", "src3"), (91, "call +1 202 555 0101 or x@y.example.com now " + prose(40), "en", "s")]
    cols = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, cols).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumn("_score", F.lit("mine")).withColumn("_pred", F.lit(1)).withColumn("_kept", F.lit(2)).withColumn("_id", F.col("doc_id")).withColumn("component_id", F.lit(5)).withColumn("length", F.lit("l"))


def test_run_on_nulls_repeats_long_texts_and_clashes(spark, tmp_path):
    path = str(tmp_path)
    docs = odd_table(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.range(80).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    left, own = spark.read.parquet(f"{path}/documents.parquet"), ["_score", "_pred", "_kept", "component_id", "length"]
    for name, stage in cp.STAGES[:4]:
        before, left = left, stage(spark, left, path).cache()
        assert left.columns == docs.columns and 0 < left.count() <= before.count()
        assert [tuple(r) for r in left.select(own).distinct().collect()] == [("mine", 1, 2, 5, "l")]
    texts = [r["text"] for r in left.collect()]
    assert len(texts) == len(set(texts)) and max(map(len, texts)) > 300_000 and not any("x@y" in t for t in texts)
    whole = cp.run(spark, path)
    assert whole.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == left.select("doc_id").distinct().count()
    (tmp_path / "empty").mkdir()
    docs.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{path}/empty/labels.parquet")
    assert cp.run(spark, f"{path}/empty").count() == 0


def test_scratch_needs_a_shared_folder_off_local_mode(spark):
    from tracemill.llm import common

    far = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *_: None)}), "sparkContext": type("X", (), {"master": "yarn"})})
    with pytest.raises(RuntimeError):
        common.scratch(far, "x")
