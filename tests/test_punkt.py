"""Sentence borders: likelihoods and decisions against a plain version, and a corpus with known abbreviations."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.operators import punkt


def token(w):
    bare = re.sub(r"""^[("'\[{]+|[)"'\]},;:]+$""", "", w)
    ending = "~" if bare.endswith(("..", "…")) else "." if bare.endswith(".") else "!" if re.search(r"[!?]$", bare) else ""
    body = re.sub(r"[.!?…]+$", "", bare).lower()
    return punkt.NUMBER if re.match(r"^[-+]?[.,]?\d[\d.,-]*$", body) else body, ending, "U" if bare[:1].isupper() else "L" if bare[:1].islower() else ""


def xl(x, p):
    return 0.0 if x == 0 else x * math.log(max(p, 1e-12))


def tie(a, b, ab, n):
    p, one, two = b / n, ab / a, (b - ab) / (n - a) if n > a else 1.0
    free = xl(ab, p) + xl(a - ab, 1 - p) + xl(b - ab, p) + xl(n - a - b + ab, 1 - p)
    return -2 * (free - (0 if a == ab else xl(ab, one) + xl(a - ab, 1 - one)) - (0 if b == ab else xl(b - ab, two) + xl(n - a - b + ab, 1 - two)))


def plain(texts):
    """Borders of each text, and the abbreviations."""
    said = [[token(w) for w in (t or "").split()] for t in texts]
    dotted, without = Counter(t for s in said for t, e, _ in s if e == "."), Counter(t for s in said for t, e, _ in s if e != ".")
    n, periods = sum(map(len, said)), dotted.total()
    short = set()
    for t, k in dotted.items():
        if re.search(r"[^\W\d_]", t):
            a, p, dots = k + without[t], periods / n, t.count(".")
            letters = len(t) - dots
            score = -2 * (xl(k, p) + xl(without[t], 1 - p) - xl(k, 0.99) - xl(without[t], 1 - 0.99)) * math.exp(-letters) * (dots + 1) * float(letters) ** -without[t]
            if score >= 0.3:
                short.add(t)
    initial = lambda t: len(t) == 1 and t.isalpha()
    border = lambda t, e: e == "!" or e == "." and t not in short and t != punkt.NUMBER and not initial(t)
    after, lower, inside, both, borders = Counter(), Counter(), Counter(), Counter(), 0
    for s in said:
        for i, (t, _, c) in enumerate(s):
            b = i > 0 and border(*s[i - 1][:2])
            borders += b
            after[t] += b
            lower[t] += c == "L"
            inside[t] += c == "U" and i > 0 and not b and s[i - 1][1] != "~"
            if i and s[i - 1][1] == "." and (s[i - 1][0] == punkt.NUMBER or initial(s[i - 1][0]) or s[i - 1][0] in short) and (re.search(r"[^\W\d_]", t) or t == punkt.NUMBER):
                both[s[i - 1][0], t] += 1
    total = lambda t: dotted[t] + without[t]
    starts = {t for t, k in after.items() if k and t.isalpha() and tie(borders, total(t), k, n) >= 30 and n * k > total(t) * borders}
    tied = {k for k, v in both.items() if v > 1 and tie(total(k[0]), total(k[1]), v, n) >= punkt.COLLOCATION and n * v > total(k[0]) * total(k[1])}

    def ends(t, e, u, c):
        fresh = c == "U" and (u in starts or lower[u] and not inside[u])
        if e == "!":
            return True
        if (t, u) in tied:
            return False
        if e == "~" or t in short and not initial(t):
            return bool(fresh)
        if t == punkt.NUMBER:
            return c != "L"
        return c != "L" and not (c == "U" and not lower[u]) if initial(t) else True

    return [[i for i in range(len(s) - 1) if s[i][1] and ends(*s[i][:2], s[i + 1][0], s[i + 1][2])] for s in said], short


def corpus(rng, n):
    say = lambda k: [rng.choice("the cat dog ran house tree walked slowly over into near and with big small".split()) for _ in range(k)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 8)):
            s = say(rng.randrange(2, 9))
            s[0] = s[0].capitalize()
            if rng.random() < 0.6:
                s += [rng.choice(["Dr.", "Mr.", "e.g.", "J.", "No."]), rng.choice(["Smith", "Jones", "4.", "cat", "12"])] + say(2)
            w += s[:-1] + [s[-1] + rng.choice([".", ".", ".", "!", "?", "...", '."'])]
        out.append(" ".join(w))
    return out


def test_borders_against_the_plain_version(spark):
    rng = random.Random(8)
    texts = [*corpus(rng, 300), None, "", "  ", "One.", "no end", "Ünder. Über. ünder x"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    model = punkt.fit(docs)
    want, short = plain([*texts, texts[0]])
    assert {r.type for r in model.types.where("abbreviation").collect()} == short and {"dr", "mr"} <= short
    got = punkt.split(docs, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.borders) == want[r.doc_id] and r.n_sentences == (len(want[r.doc_id]) + 1 if (texts[r.doc_id] or "").split() else 0)


def test_known_abbreviations_do_not_end_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(random.Random(2), 400))), "doc_id long, text string")
    model = punkt.fit(docs)
    new = spark.createDataFrame([(1, "The dog walked with Dr. Smith into house. The cat ran. Into trees!"), (2, "")], "doc_id long, text string")
    found = punkt.split(new, model).join(new, "doc_id").select("doc_id", punkt.sentences("text", "borders").alias("s"))
    assert {r.doc_id: r.s for r in found.collect()} == {1: ["The dog walked with Dr. Smith into house.", "The cat ran.", "Into trees!"], 2: []}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert punkt.split(docs, punkt.fit(docs)).collect() == []
    odd = spark.createDataFrame([(1, "a b. C", 7)], "n_sentences long, text string, `x y` int")
    assert punkt.split(odd, punkt.fit(odd)).columns == ["x y", "n_sentences", "borders"]


@pytest.mark.parametrize("a, b, ab, n", [(10, 10, 10, 100), (5, 50, 1, 60), (7, 9, 3, 1000)])
def test_pair_likelihood(spark, a, b, ab, n):
    got = spark.range(1).select(punkt.pair_likelihood(*map(F.lit, (a, b, ab, n)))).first()[0]
    assert got == pytest.approx(tie(a, b, ab, n))
