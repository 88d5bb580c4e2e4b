import hashlib
import itertools
import random
import re

import numpy as np

from tracemill.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@+1 25-()0%é\n٣") for _ in range(rng.randrange(32)))
        assert pii.base_spans(t) == plain(t)
    card = "4041894974608795"
    assert pii.base_spans(f"x {card} y") == [(2, 2, 18)]
    assert pii.base_spans("a" * 400_000 + "@" + "1" * 200_000) == []


SURE = "write to {m} now. ip 10.20.30.40 or +1 (988) 555-2485, card 4041894974608795."


def test_repeats_are_lifted_and_base_spans_stay(spark):
    rng = random.Random(1)
    mail = lambda: f"{rng.choice('abcdef')}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
    train = [SURE.format(m=mail()) + f" version {rng.randrange(9)} of 20{rng.randrange(99)}" for _ in range(300)] + [f"line {i} and {i * 7} things" for i in range(300)]
    model = pii.train(train)
    rows = [(i, t) for i, t in enumerate(train[:40])] + [(90, None), (91, ""), (92, "no digits"), (93, "x" * 3_000 + " 10.0.0.1"), (93, "x" * 3_000 + " 10.0.0.1")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base = plain(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
    assert model.spans(["x" * 300_000 + " 10.0.0.1 " + "1" * 300_000]) == [([(1, 300_001, 300_009)],) * 2]  # linear in long runs
    # a skip edge passes what one occurrence knows to the other
    g = pii.graph("see q17xk2@host7 then (q17xk2@host7) again")
    assert g.skips and len(g.spans) == 2
    weak = pii.SkipChainCrf(model.unary * 0, model.bias * 0, model.transition * 0)
    weak.unary[g.features[0][4]] = [0, 6, 0, 0, 0]
    alone = weak.marginals([pii._Graph(g.spans, g.features, g.chain, [])])[0]
    tied = weak.marginals([g])[0]
    assert tied[1, 1] > alone[1, 1] + 0.1 or alone[1, 1] > 0.9


def test_redaction_keeps_rows_and_columns(spark):
    model = pii.train([SURE.format(m="a1@b.example.com")] * 50)
    df = spark.createDataFrame([(1, "to a1@b.example.com.", "en", 20), (2, None, "en", 0), (3, "clean", None, 5)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(df, model).collect()}
    assert got[1]["text"] == "to [EMAIL]." and got[1]["n_chars"] == 11
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["lang"] is None
    assert pii.masked("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a[EMAIL]f"
    assert pii.find(df.limit(0), model).count() == 0


def test_one_sure_occurrence_reaches_every_repeat():
    model = pii.train([])
    weak = pii.SkipChainCrf(model.unary * 0, model.bias * 0, model.transition * 0)
    weak.unary[pii._bucket("before", "key")] = [0, 9, 0, 0, 0]
    g = pii.graph("key q17xk2@host7 " + "then see other words q17xk2@host7 " * 40 + "and then (q17xk2-host7) last")
    p = weak.marginals([g])[0]
    assert len(p) == 42 and p[0, 1] > 0.99
    assert p[1:41, 1].min() > 0.6 and p[1:41, 1].max() - p[1:41, 1].min() < 1e-2
    assert p[41, 1] > 0.25  # an alike form is lifted too
    assert len(g.skips) <= 2 * len(g.spans)


def test_long_runs_are_split_and_take_part():
    import time

    data = "{" + ",".join(f'"k{i}":"v"' for i in range(60)) + ',"m":"q17xk2@host7","n":["10.20.30.400","+1(988)555-24"],"z":"call4041894974608796now"}'
    text = "see q17xk2@host7 again " + data
    g = pii.graph(text)
    forms = [text[a:b] for a, b in g.spans]
    assert len(data) > 256 and forms.count("q17xk2@host7") == 2
    assert {"10.20.30.400", "+1(988)555-24", "4041894974608796"} <= set(forms)
    assert g.spans == sorted(g.spans) and all(b - a <= 256 for a, b in g.spans)
    i = [k for k, f in enumerate(forms) if f == "q17xk2@host7"]
    assert {k for k, *_ in g.skips} >= set(i)
    start = time.time()
    for odd in ("a" * 300_000 + "1", "1" * 300_000, "a1" * 150_000, "@" * 300_000, "a@" * 150_000, "1." * 150_000):
        pii.graph(odd)
    assert time.time() - start < 60


def test_messages_are_exact_on_trees():
    """Chains and ties without a loop: the marginals are those of enumerating all labellings."""
    rng = np.random.default_rng(4)
    for _ in range(12):
        model = pii.SkipChainCrf(rng.normal(size=(pii.BUCKETS, pii.LABELS)), rng.normal(size=pii.LABELS), rng.normal(size=(pii.LABELS, pii.LABELS)), (1.7, 0.6))
        feats = [[int(b) for b in rng.integers(0, pii.BUCKETS, 3)] for _ in range(4)]
        # tokens 0-1 and 2-3 are neighbours, 1 and 2 are equal: a path
        g = pii._Graph([(i, i + 1) for i in range(4)], feats, [(0, 1), (2, 3)], [(1, 4, 0), (2, 4, 0)], 1)
        phi = [model.unary[f].sum(axis=0) + model.bias for f in feats]
        want = np.zeros((4, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=5):
            energy = sum(phi[i][y[i]] for i in range(4)) + model.transition[y[0], y[1]] + model.transition[y[2], y[3]]
            energy += pii._half(1.7) * ((y[1] == y[4]) + (y[2] == y[4]))
            for i in range(4):
                want[i, y[i]] += np.exp(energy)
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(model.marginals([g])[0], want, atol=5e-3)
    # two ties in a row act as one potential between the tokens
    h, e = pii._half(1.7), np.eye(pii.LABELS)
    both = np.exp(h * e) @ np.exp(h * e)
    assert np.isclose(np.log(both[0, 0] / both[0, 1]), 1.7)


def test_learned_weights_follow_the_base_spans():
    train = [f"mail bob{i}@mail{i % 7}.example.com and again bob{i}@mail{i % 7}.example.com at 10:{i % 60}" for i in range(200)] + [f"item {i} of {i + 3}" for i in range(200)]
    model = pii.train(train)
    assert all(pii.LOOSEST <= t <= pii.TIGHTEST for t in model.ties) and model.ties[0] >= pii.TIES[0]  # equal tokens agree throughout
    base, full = model.spans(["write to bob9@mail3.example.com or item 5"])[0]
    assert base == full and [k for k, _, _ in base] == [0]


def test_columns_that_clash_pass_through(spark):
    model = pii.train([SURE.format(m="a1@b.example.com")] * 50)
    df = spark.createDataFrame([(1, "to a1@b.example.com", 7, "s", "old")], "doc_id long, text string, n_email int, spans string, _id string")
    assert tuple(pii.redact(df, model).first()) == (1, "to [EMAIL]", 7, "s", "old")
    assert pii.find(df, pii.fit(df)).first()["n_email"] == 1


def personal(rng, n):
    """Texts with a value or two of each kind among other numbers."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if pii._luhn(d + c))

    say = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    values = [lambda: f"{say(1)}{digits(2)}@{say(1)}.example.com", lambda: ".".join(str(rng.randrange(10, 256)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"+{digits(11)}", lambda: digits(rng.randrange(1, 12)), lambda: say(1)]
    return [". ".join(f"{say(4)} {rng.choice(values)()} {say(3)}" for _ in range(rng.randrange(1, 7))) + "." for _ in range(n)]


def test_disguised_mentions_are_found_by_repeats(spark):
    rng = random.Random(6)
    model = pii.train(personal(rng, 1500))
    got = pii.recovery(model, personal(rng, 400))
    assert got["hidden"] > 200 and got["recall"] > 0.6 and got["precision"] > 0.9, got
    assert model.ties[1] > pii.TIES[1]  # learned from the mentions that are alike
    text, alone = "abc +12025550143 def. Some time on 12025550143 came up, and 98765432101 too.", "abc def. Some time on 12025550143 came up."
    graphs = [pii.graph(text), pii.graph(alone)]
    graphs[0].known = pii._labels(graphs[0], pii.base_spans(text))
    said, lonely = model.marginals(graphs)
    assert said[0, 4] > 0.99 and said[1, 4] > 0.6 > 0.4 > said[2, 4] and lonely[0, 4] < 0.1  # the same number, lifted by its sure mention alone
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pii.disguised(t)[0] for t in personal(rng, 60))], "doc_id long, text string")
    assert pii.find(df, model).agg({"n_added": "sum"}).first()[0] > 20


def test_disguises_hide_from_base_patterns_and_repeat(spark):
    for t in personal(random.Random(3), 200):
        said, hidden = pii.disguised(t)
        assert (said, hidden) == pii.disguised(t)
        base = pii.base_spans(said)
        assert not any(x < b and a < y for _, a, b in hidden for _, x, y in base)
        assert len(said) >= len(t) and all(0 <= a < b <= len(said) for _, a, b in hidden)


def test_tokens_have_no_greatest_length():
    name = "a" * 400
    text = f"x{'q' * 300}9{name}@{'h' * 300}.example.com|{'7' * 500}"
    got = [text[a:b] for a, b in pii._tokens(text)]
    assert any(t.endswith(f"{name}@{'h' * 300}.example.com") for t in got) and "7" * 500 in got
    assert len(pii._shape("a1" * 100)) > 100
