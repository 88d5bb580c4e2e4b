"""Periodic runs of words, by Lyndon arrays over both orders of the alphabet, after Ellert and Fischer.

A run is a stretch with smallest period q, twice q long or more, that no neighbour extends. Every run has
a root that is the longest Lyndon word at its place under one of the two orders, so the edges of the two
Lyndon arrays (a place, its next smaller suffix) name all candidates, and the matches to the left and the
right of an edge give the run. Words are compared by their order alone; a match that was read once is not
read again: later edges inside it take its result, or go on from where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.common import extended

#: Runs of fewer words are not reported.
LEAST = 12
#: Bytes of text that one pass of a task handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 20

RUN = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))


def _edges(s: list[int], least: int, out: set[tuple[int, int, int]]) -> int:
    """Add the runs (start, length, period) with a root under the order of s, but for period 1.

    s ends with a value below all others. Returns how many pairs of words were compared, for the tests.
    """
    n = len(s) - 1
    after, after_match = [0] * n, [0] * n  # the next smaller suffix, and how far it matches
    before, before_match = [-1] * n, [0] * n  # the last smaller suffix, likewise
    stack, match = [-1], [0]  # places without a next smaller suffix yet, each with its match to the one below
    far = shift = since = 0  # s[k] == s[k - shift] for since <= k < far
    found: dict[int, tuple[int, int]] = {}  # by distance, the last stretch whose words match those at that distance
    steps = 0
    for i in range(n + 1):
        c, known = s[i], 0
        while True:
            j = stack[-1]
            if j < 0:
                v = 0
                break
            steps += 1
            if s[j] != c:
                v = 0
                if s[j] < c:
                    break
            else:
                v = known if known > 1 else 1
                exact = False
                if i < far:
                    a, b = (j - shift if j >= since else j), i - shift
                    u = after_match[a] if after[a] == b else before_match[b] if before[b] == a else -1
                    if u >= far - i:
                        v = max(v, far - i)
                    elif u >= 0:
                        v, exact = u, True
                if not exact:
                    begin = v
                    while s[i + v] == s[j + v]:
                        v += 1
                    steps += v - begin
                    if i + v > far:
                        far, shift, since = i + v, i - j, i
                if s[j + v] < s[i + v]:
                    break
            # the suffix at i is the next smaller one of that at j
            stack.pop()
            below = match.pop()
            after[j], after_match[j] = i, v
            p = i - j
            if p > 1 and (v or (j and s[j - 1] == s[i - 1])):
                lo, hi = found.get(p, (0, -1))
                if j > hi:
                    k = j
                    while k > 0 and s[k - 1] == s[k - 1 + p]:
                        k -= 1
                        if k == hi:
                            k = lo
                            break
                    steps += j - k
                    found[p] = (k, j + v)
                    if j + v - k >= p and j + v - k + p >= least:
                        out.add((k, j + v - k + p, p))
            if v > below:  # the one below differs from that at j, hence from i, where it is smaller
                v = below
                break
            known = v
        if i < n:
            before[i], before_match[i] = stack[-1], v
            stack.append(i)
            match.append(v)
    return steps


def runs_of(codes: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least `least` words, by start, then period; codes are not negative."""
    out: set[tuple[int, int, int]] = set()
    if len(codes) >= max(2, least):
        top = max(codes)
        _edges([*codes, -1], least, out)
        _edges([*(top - c for c in codes), -1], least, out)
        begin = 0
        for i in range(1, len(codes) + 1):
            if i == len(codes) or codes[i] != codes[begin]:
                if i - begin >= max(2, least):
                    out.add((begin, i - begin, 1))
                begin = i
    return sorted(out, key=lambda r: (r[0], r[2]))


def _zones(codes: np.ndarray, off: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run of at least `least` words can lie.

    In a run with period q every pair of neighbours stands twice in the text, but for one in the middle
    of a run of exactly 2 q words, whose halves then have least / 2 words or more. So a stretch between
    pairs that stand once holds no part of a run if it has fewer words.
    """
    n = len(codes)
    if n < 2:
        return []
    border = np.zeros(n + 1, dtype=bool)
    border[off] = True
    doc = np.cumsum(border[:-1])
    wide = int(codes.max()) + 1
    pair = codes[:-1].astype(np.int64) * wide + codes[1:]
    if wide * wide * (int(doc[-1]) + 1) >= 2**62:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        wide = 1 << 15  # pairs of one pass are far fewer than its square
        if pair.max() >= wide * wide:
            return [(int(a), int(b)) for a, b in zip(off[:-1], off[1:]) if b - a >= least]
    pair += doc[1:] * (wide * wide)
    order = np.argsort(pair)
    ranked = pair[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 1, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cut = border.copy()
    cut[1:-1] |= ~twice
    at = np.flatnonzero(cut)
    live = np.diff(at) >= max(2, least // 2)
    first, last = at[:-1], at[1:]
    begins = live & ~np.concatenate([[False], live[:-1] & ~border[first[1:]]])
    ends = live & ~np.concatenate([live[1:] & ~border[last[:-1]], [False]])
    return [(a, b) for a, b in zip(first[begins].tolist(), last[ends].tolist()) if b - a >= least]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the index of each text's first (one more at the end); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.not_equal(flat, "")
    at = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(keep.to_numpy(zero_copy_only=False), out=at[1:])
    return flat.filter(keep), at[off]


def _collapse(texts: pa.Array, least: int) -> tuple[list[list[dict]], pa.Array]:
    """(runs, text without repeats) of each text."""
    words, off = _words(texts)
    # places in the alphabet, by sorting: nothing here hashes
    codes = pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1 if len(words) else np.zeros(0, np.int64)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    keep = np.ones(len(words), dtype=bool)
    for a, b in _zones(codes, off, least):
        d = int(np.searchsorted(off, a, side="right")) - 1
        for start, length, period in runs_of(codes[a:b].tolist(), least):
            keep[a + start + period : a + start + length] = False
            found[d].append({"start": int(a + start - off[d]), "length": length, "period": period})
    for f in found:
        f.sort(key=lambda r: (r["start"], r["period"]))
    left = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(keep, out=left[1:])
    rest = words.filter(pa.array(keep)) if not keep.all() else words
    return found, pc.binary_join(pa.ListArray.from_arrays(pa.array(left[off], pa.int32()), rest), " ")


def _passes(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about PASS_BYTES."""
    size = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + PASS_BYTES, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs without the text, with its runs (word number, words, period; by start, then period) and the text collapsed.

    Words are what white space (0x20, 0x09-0x0D) parts. A word goes if any run of at least `least` words
    contains it after that run's first period; the others are joined by one space. Each row stands for
    itself, repeated rows alike, whole texts however long; a null or empty text has no runs and collapses
    to an empty one; an empty table gives an empty one. Columns named like the two new ones give way.
    """
    rest = [c for c in docs.columns if c != text and c not in (runs, collapsed)]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("_periodic_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            for texts in _passes(batch.column(len(rest))):
                found, short = _collapse(texts, least)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind), short.cast(pa.string())], [*rest, runs, collapsed])
                at += len(texts)

    return given.mapInArrow(work, extended(given.select(*[F.col(f"`{c}`") for c in rest]), **{runs: RUN, collapsed: T.StringType()}))
