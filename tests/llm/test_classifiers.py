import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import common, language, quality, toxicity


def junk(words, rng):
    w = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
    return rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + rng.choice(["$$$", "%%%"]) for x in w), " | ".join(w)])


def sound(words, rng):
    return ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(rng.randrange(1, 9)))


def table(spark, words, n=500):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        t = sound(words, rng) if good else junk(words, rng)
        if toxic:
            # a clause that says it of someone: a bare word alone does not make a text toxic
            t += f". You are {rng.choice(['a', 'one'])} {rng.choice(['grobnik', 'vulmash', 'zzorp'])} {rng.choice(words)}."
        docs.append((i, t, i))
        labels.append((i, int(good), int(toxic)))
    docs += [(9001, None, 1), (9002, "", 1), (9003, " ", 1), (0, docs[0][1], 0), (None, "abc", 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module, label, threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_rows_are_told_apart(spark, words, module, label, threshold):
    docs, labels, rows = table(spark, words)
    model = module.fit(docs, labels)
    got = {r["doc_id"]: r for r in module.score_documents(docs, model, threshold).collect()}
    assert module.score_documents(docs, model, threshold).count() == docs.count()
    truth = {r[0]: r[1 if label == "quality" else 2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    right = [got[i]["predicted"] == y for i, y in truth.items()]
    assert np.mean(right) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in got.values())
    assert got[9001]["score"] == got[9002]["score"]
    assert module.score_documents(docs.limit(0), model).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, words):
    docs, labels, rows = table(spark, words, 200)
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in rows], "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.slot, b.slot) and a.bias == b.bias


def test_tables_without_labels_still_score(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score_documents(docs, module.fit(docs, labels)).count() == 1


def by_definition(symbols):
    """(place, clause, role, weight) of each head, said directly: no automaton."""
    t, out = toxicity, []
    for k, s in enumerate(symbols):
        begin = max([j + 1 for j in range(k) if symbols[j] == t.BREAK], default=0)
        end = min([j for j in range(k, len(symbols)) if symbols[j] == t.BREAK], default=len(symbols))
        weight = t.NEGATED if t.NEGATION in symbols[max(begin, k - t.REACH) : k] else 1.0
        weight *= t.REPORTED if t.REPORT in symbols[:k] else 1.0
        before, clause = symbols[begin:k], symbols[:k].count(t.BREAK)
        aimed = t.ADDRESS in before or any(a == t.TARGET and t.PREDICATE in before[i:] for i, a in enumerate(before))
        if s == t.INSULT:
            right_before = before[-1:] or [t.OTHER]
            of = t.PREDICATE in before and t.TARGET not in before or right_before[0] == t.OWNER
            out.append((k, clause, 2 if aimed or right_before[0] == t.TARGET else 1 if of else 0, weight))
        elif s == t.THREAT and {t.TARGET, t.OWNER} & set(symbols[k + 1 : min(end, k + 1 + t.AHEAD)]):
            out.append((k, clause, 3, weight * (t.FIGURED if t.FIGURATIVE in symbols[k + 1 : min(end, k + 1 + t.FIGURE)] else 1.0)))
    return out


def test_composed_automaton_on_all_short_sentences():
    for n in range(1, 6):
        for symbols in itertools.product(range(11), repeat=n):
            if n < 5 and (toxicity.INSULT in symbols or toxicity.THREAT in symbols) or n == 5 and symbols[3] in (toxicity.INSULT, toxicity.THREAT) and symbols[0] > 1:
                assert toxicity.matches(list(symbols), [0] * n, [1.0] * n) == by_definition(list(symbols)), symbols
    # words between symbols count as distance
    run = lambda *x: [m[2:] for m in toxicity.matches([s for s, _ in x], [g for _, g in x], [1.0] * len(x))]
    t = toxicity
    assert run((t.NEGATION, 0), (t.INSULT, t.REACH - 1)) == [(0, t.NEGATED)] and run((t.NEGATION, 0), (t.INSULT, t.REACH)) == [(0, 1.0)]
    assert run((t.THREAT, 0), (t.TARGET, t.AHEAD - 1)) == [(3, 1.0)] and run((t.THREAT, 0), (t.TARGET, t.AHEAD)) == []
    assert run((t.TARGET, 0), (t.INSULT, 0)) == [(2, 1.0)] and run((t.TARGET, 0), (t.INSULT, 1)) == [(0, 1.0)]
    # of the same words in a clause the strongest counts, and each clause counts its own
    one = t.run_sentence([t.INSULT, t.TARGET, t.INSULT, t.INSULT, t.BREAK, t.INSULT], [0] * 6, [3.0] * 6, [5, 1, 5, 6, 0, 5])
    assert sorted(one) == [(0, 3.0), (0, 3.0), (2, 3.0)]


@pytest.mark.parametrize("labelled", [True, False])
def test_the_grammar_decides_whatever_the_labels(spark, words, labelled):
    rng = random.Random(8)
    # labels that would have negated insults toxic, threats clean, and one bare word enough
    texts = [f"{sound(words, rng)} {end}" for end in ["not an idiot", "moron"] * 60 + ["i will kill you", "you are scum", "nothing here"] * 60]
    y = np.array([1] * 120 + [0] * 180) if labelled else np.zeros(0, np.int64)
    model = toxicity.train(pa.array(texts if labelled else [], pa.string()), y, 0.1)
    score = lambda *t: model.score(pa.array(t))
    plain, told, negated, both = score("you are an idiot", "he said you are an idiot", "you are not an idiot", "he said you are not an idiot")
    assert plain >= 0.5 > told > negated > both
    assert (score("I will kill you", "we shall kill them all") >= 0.5).all()
    assert (score("I will not kill you", "he wrote: I will kill you", "kill", "kill time", "idiot", "the word is there", "") < 0.5).all()
    harmless = score("This garbage collector frees your memory", "you should take out the trash", "Your fool-proof plan", "I will kill them with kindness", "kill your darlings", "idiot idiot idiot")
    assert (harmless < 0.5).all()
    assert (score("you're an idiot", "they are such an idiot", "I will murder every one of you") >= 0.5).all()
    assert score("you idiot")[0] >= score("the boss is idiot")[0] >= score("idiot")[0] > score("")[0]
    assert (model.weights >= 0).all()


def test_one_hot_id_does_not_fill_the_sample(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") < 18_000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id")).alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    texts, y = common.labelled_sample(docs, labels, "toxic", 300)
    assert len(texts) == len(y) <= 600 and sum(t.as_py() == "some words here 0" for t in texts) <= 1
    again, _ = common.labelled_sample(docs.repartition(7), labels, "toxic", 300)
    assert texts.equals(again)


def test_bytes_of_a_fit_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 1000 * (i + 1)) for i in range(30)], "doc_id long, text string")
    picked = docs.select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_order"))
    got = common.bounded_texts(docs, picked, [], budget=10_000).column("text").to_pylist()
    assert [len(t) for t in got] == [1000, 2000, 3000, 4000]
    assert common.bounded_texts(docs, picked.limit(0), []).num_rows == 0


def test_long_text_and_ties_score_as_their_parts_do(words):
    rng = random.Random(2)
    texts = [sound(words, rng) for _ in range(30)] + [junk(words, rng) for _ in range(30)]
    model = quality.train(pa.array(texts), np.array([1] * 30 + [0] * 30), 0.5)
    long = " ".join(texts[:30]) * 90
    assert len(long) > 500_000 and model.score(pa.array([long, long, None]))[0] > 0.9
    grammar = toxicity.train(pa.array([], pa.string()), np.zeros(0, np.int64), 0.1)
    assert grammar.score(pa.array([long + " you idiot", long, long + " you idiot"])).round(6).tolist() == grammar.score(pa.array(["x you idiot", "x", "x you idiot"])).round(6).tolist()
    s = model.score(pa.array(texts + texts))
    assert np.allclose(s[:60], s[60:], atol=1e-6)


def test_language(spark):
    rng = random.Random(4)
    tongues = {"aa": "the and ing ed th er on".split(), "bb": "ung sch der ein lich keit ß".split(), "cc": "ción que los ñ ado mente".split()}
    text = lambda k: " ".join("".join(rng.choice(tongues[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120)))
    rows = [(i, text(k), k) for i, k in enumerate(rng.choice(list(tongues)) for _ in range(400))]
    odd = [(5001, None, "aa"), (5002, "12 34 !!", "bb"), (5003, "", None), (5004, "ñ", "cc"), (None, "the and", "aa"), (5005, "the ing and " * 30_000, None), (5005, "the ing and " * 30_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("_id", F.lit(1)).withColumn("_lang", F.lit("zz")).withColumn("score", F.lit("old"))
    net = language.fit(df)
    got = {r["doc_id"]: r for r in language.identify(df, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5001, 5002, 5003))
    assert got[5005]["lang_pred"] == "aa" and got[5001]["_lang"] == "zz" and language.identify(df, net).count() == df.count()
    test = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == k for i, k in test]) > 0.97
    assert net.langs == ["aa", "bb", "cc"]
    flipped = spark.createDataFrame([(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows] + odd, "doc_id long, text string, lang string")
    assert np.array_equal(language.fit(flipped).out, net.out)
    assert language.identify(df.limit(0), net).count() == 0
