import itertools
import random
import re

import pytest

from tracemill.llm.jaccard_join import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            par[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n, hot=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    base, passage = [text(rng.randrange(1, 90)) for _ in range(12)], text(40)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = passage + " " + text(rng.randrange(3, 30))
        elif kind < 0.55:
            t = rng.choice(["", " \t\n", "One", "one TWO", None, "É é", "a b c d e", "A  b\nc d\te"])
        else:
            t = text(rng.randrange(1, 60))
        rows.append((i * 3 + 1, t))
    hot_base = text(60).split(" ")
    for i in range(hot):
        w = list(hot_base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100_000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, n, hot", [(1, 250, 0), (2, 120, 260)])
def test_same_as_brute_force(spark, seed, n, hot):
    rows = corpus(seed, n, hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r)[:3] for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 3), (1, "a b c d e f", 3), (2, None, 1), (3, "", 1), (None, "A B C D E F", 9)], "doc_id long, text string, component_id int")
    got = sorted((tuple(r)[:3] for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (None, 2, 1)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def links(rows):
    """Number of other distinct sets that each row's set links with."""
    own = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        own[d] = frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    sets = set(own.values())
    told = {s: sum(x != s and len(s & x) > 0 and 100 * len(s & x) >= 80 * len(s | x) for x in sets) for s in sets}
    return {d: told[s] for d, s in own.items()}


@pytest.mark.parametrize("block, tile", [(8192, 2048), (70, 16)])
def test_no_link_of_a_hot_group_is_lost(spark, monkeypatch, block, tile):
    monkeypatch.setattr("tracemill.llm.jaccard_join.BLOCK_SETS", block, raising=False)
    monkeypatch.setattr("tracemill.llm.jaccard_join.TILE", tile, raising=False)
    rows = [r for r in corpus(4, 40, 300) if not r[1] or r[1].isascii()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = links(rows)
    assert max(want.values()) > 50
    assert {r["doc_id"]: r["n_links"] for r in near_duplicates(df).collect()} == want


def test_near_copies_are_not_listed_pair_by_pair(spark, monkeypatch):
    """What is written for a group below the heavy class grows with the group, not with its square."""
    from tracemill.llm import jaccard_join

    listed, verify = [], jaccard_join.verify

    def counted(*args):
        pairs = next(x for x in args if {"a", "b"} <= set(getattr(x, "columns", ())))
        listed.append(pairs.select("a", "b").distinct().count())
        return verify(*args)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    rng, rows = random.Random(6), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(50):
            w = list(base)
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 49), (50, 49), (100, 49)}
    assert sum(listed) <= 10 * len(rows)


def test_the_bit_map_comes_in_few_jobs_whatever_the_partitions(spark):
    import numpy as np

    from tracemill.llm.jaccard_join import _bloom, _slot

    ids, held = spark.range(0, 6000, 3).withColumnRenamed("id", "rep"), {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bit map", "bit map")
        whole, bits = _bloom(ids, 2000)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bit map")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < len(jobs) < 8
    assert set(np.flatnonzero(np.unpackbits(whole, bitorder="little"))) == {r["s"] for r in ids.select(_slot("rep", bits).alias("s")).collect()}
