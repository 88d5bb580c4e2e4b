"""License scans against a plain version in Python, and the rules against samples of their own patterns."""

import random
import re
import time
from re import _constants as K, _parser

import pytest

from tracemill.llm import license_scan
from tracemill.llm.license_rules import BASE, RULES, wrapped


def sample(tree, rng):
    """A string that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        if op == K.LITERAL:
            out += chr(arg)
        elif op == K.NOT_LITERAL:
            out += "q"
        elif op == K.IN:
            kind, v = rng.choice(arg)
            out += chr(v) if kind == K.LITERAL else chr(rng.randint(*v))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            lo, hi, sub = arg
            if len(sub) == 1 and sub[0][0] in (K.IN, K.NOT_LITERAL):
                hi = min(hi, 4)  # letters of one word
            assert hi < 10, "words are bounded"
            out += "".join(sample(sub, rng) for _ in range(rng.randint(lo, hi)))
        elif op == K.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op == K.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        else:
            raise AssertionError(op)
    return out


def test_every_match_has_a_gate_word_and_borders():
    rng = random.Random(1)
    assert len(RULES) > 300 and [(r.label, r.pattern) for r in RULES[: len(BASE)]] == list(BASE)
    for r in RULES:
        tree = _parser.parse(wrapped(r.pattern))
        for _ in range(40):
            s = sample(tree, rng)
            words = s[1:-1].split("  ")
            assert re.fullmatch(wrapped(r.pattern), s) and all(words) and not any(" " in w for w in words), (r, s)
            assert set(words) & set(r.gates), (r, s)
            assert all(re.fullmatch(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", w) for w in words), (r, s)


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line, found = " " + "  ".join(words) + " ", []
    for i, r in enumerate(RULES):
        for m in re.finditer(wrapped(r.pattern), line):
            start = line[: m.start(1)].count("  ")
            found.append((start, start + len(m[1].split("  ")), r.priority, i, r.label, i < len(BASE)))

    def outdone(d, e):
        contains, wider = e[0] <= d[0] and e[1] >= d[1], e[1] - e[0] > d[1] - d[0]
        return e[0] < d[1] and d[0] < e[1] and (e[2] > d[2] or e[2] == d[2] and contains and (wider or e[3] < d[3]))

    return len(words), sorted(d for d in found if d[5]), sorted(d for d in found if d[5] or not any(outdone(d, e) for e in found))


def test_scan_against_the_plain_version(spark):
    rng = random.Random(2)
    trees = [_parser.parse(wrapped(r.pattern)) for r in RULES]
    texts = [None, "", "...", "CC BY", "cc-by-nc 4.0, CC  BY\nnc", "ÀLL RIGHTS RESERVED all Rights, reserved", "general public license general public license"]
    for _ in range(250):
        parts = [sample(rng.choice(trees), rng) if rng.random() < 0.7 else rng.choice(["the", "version", "3", "gnu", "İ Straße", "license"]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(p.upper() if rng.random() < 0.2 else p for p in parts))
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in enumerate(texts)] + [(3, "CC BY", 9, "z")] * 2, "doc_id long, text string, score int, `a b` string")
    got = license_scan.scan(docs)
    assert got.columns == ["doc_id", "a b", "n_words", "base", "spans", "score"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, base, kept = plain(texts[r.doc_id])
        assert (r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.spans]) == (n, base, kept), texts[r.doc_id]
        best = {d[4]: max(e[2] for e in kept if e[4] == d[4]) for d in kept}
        assert r.score == 1 - 2.0 ** -sum(best.values())
    assert license_scan.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["cc by ", "GNU General Public License version 3 all rights reserved ", "licensed under the mit license "])
def test_long_texts_with_many_detections(spark, piece):
    text = piece * 20000
    began = time.time()
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_words == 20000 * len(piece.split()) and len(row.spans) >= 20000
    assert time.time() - began < 60


def test_one_stage_without_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Join|Generate", plan)
