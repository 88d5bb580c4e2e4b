"""The classifiers' forward passes said directly, and the pipeline's classifier stages text by text against them."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from tracemill.llm import language, quality
from tracemill.llm.shingles import word_hashes

WHITE = b" \t\n\x0b\x0c\r"


def quality_by_hand(model, text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size = 1 << quality.BITS
    slots = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) >> (64 - quality.BITS) for w in words]
    slots += [3 * size for a, b in zip(words, words[1:]) if a.lower() == b.lower()]
    plain = [32 if c in WHITE else c for c in raw]
    for n, key, table in ((3, 0x9E3779B1, 1), (4, 0x85EBCA77, 2)):
        for i in range(len(raw) - n + 1):
            if all(c not in WHITE for c in raw[i + 1 : i + n - 1]):
                number = sum(c << 8 * j for j, c in enumerate(plain[i : i + n]))
                slots.append(table * size + (number * key % 2**32 >> 32 - quality.BITS))
    mean = sum(float(model.slot[s]) for s in slots) / max(1, len(slots))
    return 1 / (1 + math.exp(-(model.bias + mean)))


def language_by_hand(net, text):
    raw = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return language.UNKNOWN, 0.0
    starts = range(0, max(1, len(raw) - language._TOP + 1), language._STEP)
    total, size = np.zeros(len(net.langs)), 0.0
    for s in starts:
        part = raw[s : s + language.WINDOW]
        win = list(part) + [0] * (language.WINDOW - len(part))
        best = np.full(net.conv.shape[1], -np.inf)
        for p in range(language._STEP):
            best = np.maximum(best, sum(net.embed[win[p + j]].astype(float) @ net.conv[j * language.DIM : (j + 1) * language.DIM].astype(float) for j in range(language._TOP)))
        z = np.maximum(best + net.conv_bias, 0) @ net.out + net.out_bias
        share = len(part) / language.WINDOW
        total += np.log(np.maximum(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), 1e-6)) * share
        size += share
    z = total / math.sqrt(max(size, 1))
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return net.langs[int(p.argmax())], float(p.max())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_quality_pass_and_stage_text_by_text(spark, docs):
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    odd = ["", None, "a", "ab", "a a A", " \n x  y\t", "ñandú ñandú", "word " * 50]
    got = model.score(pa.array(odd))
    assert got == pytest.approx([quality_by_hand(model, t) for t in odd], abs=1e-6)
    rows = [(r.doc_id, r.text, quality_by_hand(model, r.text) if len(r.text or "") < 3000 else None) for r in docs.collect()]
    kept = {r.doc_id for r in cp.keep_quality(spark, docs, "/root/testdata/sf0.001").collect()}
    told = [(i, s) for i, _, s in rows if s is not None and abs(s - cp.QUALITY) > 1e-5]
    assert len(told) > 100 and all((i in kept) == (s >= cp.QUALITY) for i, s in told)


def test_language_pass_and_stage_text_by_text(spark, docs):
    net = language.fit(docs)
    rng = random.Random(1)
    odd = ["ab", "the", "ß", "x" * 125, "x" * 126, "y" * 250, "z z " * 70, "12", "", None]
    names, scores = net.predict(pa.array(odd))
    for t, n, s in zip(odd, names, scores):
        want = language_by_hand(net, t)
        assert n == want[0] and s == pytest.approx(want[1], abs=1e-4), t
    some = [r for r in docs.collect() if len(r.text or "") < 1200]
    some = rng.sample(some, min(40, len(some)))
    kept = {r.doc_id for r in cp.keep_language(spark, docs, "").collect()}
    for r in some:
        pred, score = language_by_hand(net, r.text)
        if abs(score - cp.LANGUAGE) > 1e-3:
            assert (r.doc_id in kept) == (pred != language.UNKNOWN and score >= cp.LANGUAGE)
