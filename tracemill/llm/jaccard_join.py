"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links form.

A document's set is its distinct word shingles. All sets are sorted by one global order, rare
shingles first: frequency class, then hash. Two sets that link share at least `o` shingles, so
their prefixes of `n - o + l` shingles share at least `l` of them. Each document picks its own
`l`: it lengthens its prefix while the posting lists that it would then read, and the candidates
that would then be left to verify, are estimated to cost less. A pair is compared at the smaller
`l` of the two, so both prefixes are long enough, and is verified only if it shares that many.

Steps, none of which needs a group of documents in one task:

1. `classes`: equal sets form one class; all later steps see one text for each class.
2. Near copies meet first: sets that have one of SIGNS least hashes in common are compared with one
   of them, and components are formed. Later steps list no pair within a component, so what they
   write does not grow with the square of a group of near copies.
3. `frequent`: exact document frequencies, counted over all classes in hash buckets as packed
   blobs. Only the classes of the most frequent shingles are kept, at most TABLE_CAP of them.
   The order stays a total order whatever is kept, so the cap bears on cost alone.
4. Light postings (class below the heavy one): every bucket is bounded, pairs of unlike components are counted.
5. Heavy postings: a node has one only if its prefix runs out of light shingles, and a pair that
   meets only there shares nothing but heavy shingles, at most the smaller of their numbers.
   Each heavy list is first compared with its best pivot (linear), then only members of
   components that are still apart and whose bound allows a link are compared.
6. Verification computes whole sets of the named documents and counts intersections exactly. Pairs
   are dealt to cells by what they have in common, and a text goes once to each cell, not to each pair.
7. Links are counted after the groups are known: a link lies within one group, whose sets meet in
   salted blocks, every block with every other; small groups share cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import discard, materialise
from tracemill.llm.components import connected_components
from tracemill.llm.shingles import set_key, shingle_sets

#: Frequencies below this are not told apart.
LEAST_FREQ = 8
#: Shingles in at least 2 ** HEAVY_CLASS sets are heavy.
HEAVY_CLASS = 6
#: At most so many frequent shingles are broadcast (10 bytes each).
TABLE_CAP = 1 << 20
#: Longest extension of a prefix.
MAX_MATCHES = 6
#: Shingles that one bucket of a count or of postings should hold.
BUCKET_ROWS = 400_000
#: Cost of reading one posting, against comparing one shingle of a candidate.
SCAN_COST, COMPARE_COST = 1.0, 0.02
FLUSH = 1_500_000
#: Sets and shingles that one salted block of a group should hold, and sets that one tile compares.
BLOCK_SETS, BLOCK_SHINGLES, TILE = 8192, 4_000_000, 2048
#: Least hashes of a set by which near copies meet.
SIGNS = 4
#: Shingles and sets that one cell of a verification, or of small groups, should hold.
CELL_SHINGLES, CELL_SETS = 1_000_000, 2048
#: Members that one block of a heavy list should hold.
LIST_BLOCK = 2048
_U = np.uint64


def need(n: int, percent: int = 80) -> int:
    """Smallest overlap that a set of n may have with any set that it links with."""
    return -(-percent * n // 100)


def _pack(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blobs, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


_SIGN = (np.random.default_rng(41).integers(1, 2**63, SIGNS, dtype=np.uint64) << _U(1)) + _U(1)


def _signs(s: np.ndarray) -> list[int]:
    """Least values of a set under SIGNS orders; two sets of similarity J have each in common with chance J."""
    with np.errstate(over="ignore"):
        return [int((s * m).min().view(np.int64)) if len(s) else 0 for m in _SIGN]


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, x, n, h1, h2, s0...): hash of every document's text; size, digest and least hashes of its set."""
    signs = [f"s{i}" for i in range(SIGNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"))
            keys = [(len(s), *set_key(s), *_signs(s)) for s in sets]
            told = np.array(keys, np.int64).reshape(len(keys), 3 + SIGNS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("x"), *[pa.array(told[:, i].copy()) for i in range(3 + SIGNS)]], names=["doc_id", "x", "n", "h1", "h2", *signs])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("x")).mapInArrow(run, "doc_id long, x long, n long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in signs))


def _bits(total: int) -> int:
    return max(3, math.ceil(math.log2(max(1, total / BUCKET_ROWS))))


def frequent(docs: DataFrame, total: int) -> DataFrame:
    """(t, cls): 48-bit shingle and floor(log2 frequency) of each shingle that LEAST_FREQ rows or more have."""
    bits = _bits(total)
    width = -(-(48 - bits) // 8)
    keep = _U((1 << (48 - bits)) - 1)

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t = np.sort(np.concatenate(parts))
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        n = np.diff(np.append(edge, len(t)))
        t = t[edge]
        cut = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(48 - bits))
        rows = []
        for k in range(1 << bits):
            a, b = cut[k], cut[k + 1]
            if a < b:
                more = n[a:b] > 1
                x = t[a:b] & keep
                rows.append((k, _pack(x[~more], width), _pack(x[more], width), n[a:b][more].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["k", "one", "more", "times"])

    def spread(batches):
        parts, size = [], 0
        for b in batches:
            for s in shingle_sets(b.column("text")):
                parts.append(s >> _U(16))
                size += len(s)
                if size > FLUSH:
                    yield from emit(parts)
                    parts, size = [], 0
        if parts:
            yield from emit(parts)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        one, more = _unpack(pdf["one"], width), _unpack(pdf["more"], width)
        times = np.frombuffer(b"".join(pdf["times"]), dtype="<u4").astype(np.int64)
        t = np.concatenate([one, more])
        n = np.concatenate([np.ones(len(one), np.int64), times])
        o = np.argsort(t, kind="stable")
        t, n = t[o], n[o]
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, edge) if len(t) else n
        t = t[edge]
        often = n >= LEAST_FREQ
        top = _U(int(pdf["k"].iloc[0])) << _U(48 - bits)
        return pd.DataFrame({"t": (t[often] | top).view(np.int64), "cls": np.floor(np.log2(n[often])).astype(np.int32)})

    blobs = docs.select("text").mapInArrow(spread, "k int, one binary, more binary, times binary")
    return blobs.groupBy("k").applyInPandas(count, "t long, cls int")


def _bounded_table(freq: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted shingles and their classes, whole classes from the top, no more than TABLE_CAP; the heavy class."""
    sizes = {r["cls"]: r["n"] for r in freq.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    least, left = max(sizes, default=0) + 1, TABLE_CAP
    for c in sorted(sizes, reverse=True):
        left -= sizes[c]
        if left < 0:
            break
        least = c
    got = freq.where(F.col("cls") >= least).toArrow()
    t, c = got.column("t").to_numpy().astype(np.uint64), got.column("cls").to_numpy().astype(np.uint8)
    o = np.argsort(t)
    return t[o], c[o], max(HEAVY_CLASS, least)


def _ordered(sets: list[np.ndarray], table: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each set's 48-bit shingles in the global order, and their classes."""
    if not sets:
        return
    t = np.concatenate(sets) >> _U(16)
    if len(table):
        at = np.minimum(np.searchsorted(table, t), len(table) - 1)
        c = np.where(table[at] == t, cls[at], 0).astype(np.uint64)
    else:
        c = np.zeros(len(t), np.uint64)
    key = (c << _U(48)) | t
    low = _U((1 << 48) - 1)
    a = 0
    for s in sets:
        k = np.sort(key[a : a + len(s)])
        a += len(s)
        yield k & low, (k >> _U(48)).astype(np.int64)


def matches_for(cls: np.ndarray, n: int, first: int, light: int, top: int) -> int:
    """How many shared prefix shingles to require: the cheapest of 1 to MAX_MATCHES.

    cls are the classes of the set in order, first the length of the shortest prefix, light the
    number of light shingles, top the largest number allowed. A prefix that reads s postings
    leaves at most s / l candidates with l matches.
    """
    most = max(1, min(MAX_MATCHES, top, light - first + 1))
    freq = np.where(cls[: first + most - 1] > 0, 2.0 ** (cls[: first + most - 1] + 0.5), 1.0) - 1
    read = np.cumsum(freq)[first - 1 :]
    if not len(read) or read[0] <= 0:
        return 1
    l = np.arange(1, len(read) + 1)
    cost = SCAN_COST * read + COMPARE_COST * n * read / l
    return int(np.argmin(cost)) + 1


def light_pairs(docs: DataFrame, shared, heavy: int, total: int, percent: int) -> DataFrame:
    """(a, b): nodes of unlike components that share enough light prefix shingles, a < b, each pair once."""
    bits = _bits(total // 4)
    width = -(-(48 - bits) // 8)
    keep = _U((1 << (48 - bits)) - 1)

    def emit(parts):
        t, node, c, n, lev = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(t, kind="stable")
        t, node, c, n, lev = t[o], node[o], c[o], n[o], lev[o]
        cut = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(48 - bits))
        rows = [(k, _pack(t[a:b] & keep, width), node[a:b].tobytes(), c[a:b].tobytes(), n[a:b].tobytes(), lev[a:b].tobytes()) for k in range(1 << bits) if (a := cut[k]) < (b := cut[k + 1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(6)], names=["k", "t", "node", "c", "n", "lev"])

    def spread(batches):
        table, cls = shared.value
        parts, size = [], 0
        for b in batches:
            nodes, groups = b.column("node").to_pylist(), b.column("c").to_pylist()
            for (t, c), node, group in zip(_ordered(shingle_sets(b.column("text")), table, cls), nodes, groups):
                n = len(t)
                first = n - need(n, percent) + 1
                light = int(np.searchsorted(c, heavy))
                l = matches_for(c, n, first, light, need(n, percent)) if light >= first else 1
                p = min(first + l - 1, light)
                if p:
                    level = np.maximum(1, np.arange(1, p + 1) - first + 1).astype(np.uint8)
                    parts.append((t[:p], np.full(p, node, np.int64), np.full(p, node ^ group, np.int64), np.full(p, n, np.uint32), level * np.uint8(16) + np.uint8(l)))
                    size += p
            if size > FLUSH:
                yield from emit(parts)
                parts, size = [], 0
        if size:
            yield from emit(parts)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _unpack(pdf["t"], width)
        node, c, n, lev = (np.frombuffer(b"".join(pdf[x]), dtype=d) for x, d in (("node", np.int64), ("c", np.int64), ("n", np.uint32), ("lev", np.uint8)))
        o = np.lexsort((node, t))
        t, node, c, n, lev = t[o], node[o], (node ^ c)[o], n[o].astype(np.int64), lev[o].astype(np.int64)
        once = np.ones(len(t), bool)
        once[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
        t, node, c, n, lev = t[once], node[once], c[once], n[once], lev[once]
        twin = np.zeros(len(t) + 1, bool)
        twin[1:-1] = t[1:] == t[:-1]
        again = twin[1:] | twin[:-1]
        t, node, c, n, lev = t[again], node[again], c[again], n[again], lev[again]
        found = []
        d, at = 1, np.arange(len(t))
        while True:
            at = at[at + d < len(t)]
            at = at[t[at] == t[at + d]]
            if not len(at):
                break
            i, j = at, at + d
            l = np.minimum(lev[i] & 15, lev[j] & 15)
            ok = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.maximum(lev[i] >> 4, lev[j] >> 4) <= l)
            found.append((node[i[ok]], node[j[ok]], l[ok]))
            d += 1
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "l": np.zeros(0, np.int32), "c": np.zeros(0, np.int32)})
        a, b, l = (np.concatenate(x) for x in zip(*found))
        # nodes of one list are in ascending order, so a < b
        return pd.DataFrame({"a": a, "b": b, "l": l.astype(np.int32)}).groupby(["a", "b", "l"], sort=False).size().rename("c").reset_index().astype({"c": np.int32})

    blobs = docs.select("node", "c", "text").mapInArrow(spread, "k int, t binary, node binary, c binary, n binary, lev binary")
    met = blobs.groupBy("k").applyInPandas(pairs, "a long, b long, l int, c int")
    return met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("l").alias("l")).where("c >= l").select("a", "b")


def heavy_postings(docs: DataFrame, shared, heavy: int, percent: int) -> DataFrame:
    """(t, node, n, h, c): heavy prefix shingles of nodes whose light ones run out, h heavy ones in all, c their component."""

    def run(batches):
        table, cls = shared.value
        for b in batches:
            ts, nodes, ns, hs, cs = [], [], [], [], []
            for (t, c), node, group in zip(_ordered(shingle_sets(b.column("text")), table, cls), b.column("node").to_pylist(), b.column("c").to_pylist()):
                n = len(t)
                first, light = n - need(n, percent) + 1, int(np.searchsorted(c, heavy))
                if first > light:
                    ts.append(t[light:first].view(np.int64))
                    nodes.append(np.full(first - light, node, np.int64))
                    ns.append(np.full(first - light, n, np.int64))
                    hs.append(np.full(first - light, n - light, np.int64))
                    cs.append(np.full(first - light, group, np.int64))
            if ts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ts, nodes, ns, hs, cs)], names=["t", "node", "n", "h", "c"])

    return docs.select("node", "c", "text").mapInArrow(run, "t long, node long, n long, h long, c long").dropDuplicates(["t", "node"])


def _may_link(x: str, y: str, percent: int) -> str:
    """Bound on the overlap of two sets that share heavy shingles only."""
    return f"{percent} * ({x}.n + {y}.n) <= {100 + percent} * least({x}.h, {y}.h) and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"


def _slot(column: str, bits: int):
    """Place of an id in a bit map of 2 ** bits."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)


def _bloom(ids: DataFrame, count: int, column: str = "rep") -> tuple[np.ndarray, int]:
    """A bit map of hashed ids, of at most 2 ** 27 bits; it only spares the shuffle some texts.

    Slots are made distinct before they shuffle and set by range, so that no task and not the
    driver sees more than the map's own size. The map comes in one job: an iterator over the
    partitions would run a job for each of them, one after another, and the driver remembers jobs.
    """
    bits = max(12, min(27, math.ceil(math.log2(max(1, count))) + 4))
    low = bits - 6

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["s"].to_numpy()
        out = np.zeros(1 << (low - 3), np.uint8)
        at = s & ((1 << low) - 1)
        np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pd.DataFrame({"r": [int(s[0] >> low)], "m": [out.tobytes()]})

    slots = ids.select(_slot(column, bits).alias("s")).distinct()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in slots.groupBy(F.shiftright("s", low).alias("_r")).applyInPandas(fill, "r int, m binary").collect():
        part = np.frombuffer(bytes(row["m"]), np.uint8)
        whole[row["r"] * len(part) : (row["r"] + 1) * len(part)] = part
    return whole, bits


def _texts_of(docs: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Rows of docs whose id (column by) is in wanted (by, distinct), and a few others; docs has longs and text."""
    bloom, bits = _bloom(wanted, wanted.count(), by)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def pick(batches):
        m = shared.value
        for b in batches:
            at = b.column("_slot").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(m[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).select(names)

    names = docs.columns
    kinds = ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names)
    return docs.where(f"{by} is not null").withColumn("_slot", _slot(by, bits)).mapInArrow(pick, kinds)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


CELL = ["big", "g", "i", "j"]


def _cells(size: DataFrame, sets: int, shingles: int) -> tuple[DataFrame, Callable]:
    """(g, k) of each group g with m sets of s shingles in all, and the columns of a cell for two blocks x, y of it.

    A group is cut into k blocks, every two of which meet in a cell; groups of one block share cells.
    """
    total = size.agg(F.sum("s")).first()[0] or 0
    shares = max(1, math.ceil(total / CELL_SHINGLES))
    blocks = size.select("g", F.greatest(F.ceil(F.col("m") / sets), F.ceil(F.col("s") / shingles)).cast("int").alias("k"))
    big = F.col("k") > 1

    def cell(x, y):
        return [big.alias("big"), F.when(big, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(shares))).alias("g"), F.least(x, y).alias("i"), F.greatest(x, y).alias("j")]

    return blocks, cell


def _block(node: str, salt: int):
    return F.expr(f"cast(pmod(xxhash64({node}, {salt}), k) as int)")


def verify(pairs: DataFrame, nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(a, b): the pairs of nodes whose sets link, a < b.

    nodes has (node, n); texts gives (node, text) of those nodes that a table (node) names, and a few others. A pair's group is the
    smallest node that either of the two is paired with, so near copies come together.
    """
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "met")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("low")).join(nodes, "node")
    ends = [low.select(F.col("node").alias(x), F.col("low").alias(f"low_{x}"), F.col("n").alias(f"n_{x}")) for x in ("a", "b")]
    named = materialise(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n_a", "n_b", F.least("low_a", "low_b").alias("g")), "named")
    own = named.select("g", F.col("a").alias("node"), F.col("n_a").alias("n")).unionByName(named.select("g", F.col("b").alias("node"), F.col("n_b").alias("n"))).distinct()
    blocks, cell = _cells(own.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s")), CELL_SETS, CELL_SHINGLES)
    dealt = materialise(named.join(blocks, "g").select(*cell(_block("a", 13), _block("b", 13)), "a", "b"), "dealt")
    at = dealt.select(*CELL, F.col("a").alias("node")).unionByName(dealt.select(*CELL, F.col("b").alias("node"))).distinct()
    read = at.join(texts(at.select("node").distinct()), "node").select(*CELL, "node", F.lit(None).cast("long").alias("b"), "text")
    rows = read.unionByName(dealt.select(*CELL, F.col("a").alias("node"), "b", F.lit(None).cast("string").alias("text")))

    def meet(t: pa.Table) -> pa.Table:
        asked = t.column("b").is_valid()
        told, t = t.filter(asked), t.filter(pc.invert(asked))
        sets = dict(zip(t.column("node").to_pylist(), shingle_sets(t.column("text"))))
        a, b = told.column("node").to_pylist(), told.column("b").to_pylist()
        keep = []
        for u, v in zip(a, b):
            x, y = sets[u], sets[v]
            k = _shared(x, y)
            keep.append(100 * k >= percent * (len(x) + len(y) - k))
        return told.select(["node", "b"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialise(rows.groupBy(*CELL).applyInArrow(meet, "a long, b long"), "links")
    discard(pairs, named, dealt)
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of each set of a with each of b.

    Shingles that many pairs share are counted by products of 0/1 matrices, the others pair by pair.
    """
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    names, cols = np.unique(np.concatenate(a + b), return_inverse=True)
    cols = [cols[: len(rows[0])], cols[len(rows[0]) :]]
    freq = [np.bincount(c, minlength=len(names)) for c in cols]
    met = freq[0] * freq[1]
    out = np.zeros((len(a), len(b)), np.int64)
    # few pairs for each shingle
    few = (met > 0) & (met <= 64)
    side = []
    for r, c in zip(rows, cols):
        at = few[c]
        o = np.argsort(c[at], kind="stable")
        side.append((r[at][o], c[at][o]))
    (ra, ca), (rb, cb) = side
    if len(ra):
        begin, n = np.searchsorted(cb, ca), freq[1][ca]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out += np.bincount(np.repeat(ra, n) * len(b) + rb[at], minlength=out.size).reshape(out.shape)
    # many: runs of columns, exact in 32-bit floats
    many = np.flatnonzero(met > 64)
    place = np.full(len(names), -1)
    place[many] = np.arange(len(many))
    order = []
    for r, c in zip(rows, cols):
        p = place[c]
        o = np.argsort(p, kind="stable")
        order.append((r[o], p[o]))
    for lo in range(0, len(many), TILE):
        width = min(TILE, len(many) - lo)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for (r, p), m in zip(order, (x, y)):
            i, j = np.searchsorted(p, [lo, lo + width])
            m[r[i:j], p[i:j] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def block_links(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of the other block each set links with; of its own block, itself aside, if two is None."""
    own, other = one, one if two is None else two
    n_own, n_other = (np.array([len(s) for s in x], np.int64) for x in (own, other))
    got = [np.zeros(len(own), np.int64), np.zeros(len(other), np.int64)]
    for i in range(0, len(own), TILE):
        for j in range(i if two is None else 0, len(other), TILE):
            k = _overlaps(own[i : i + TILE], other[j : j + TILE])
            link = 100 * k >= percent * (n_own[i : i + TILE, None] + n_other[None, j : j + TILE] - k)
            if two is None and i == j:
                np.fill_diagonal(link, False)
                got[0][i : i + TILE] += link.sum(axis=1)
            else:
                got[0][i : i + TILE] += link.sum(axis=1)
                got[0 if two is None else 1][j : j + TILE] += link.sum(axis=0)
    return got[0], got[1]


def group_links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, n_links): exact numbers of links among the nodes (node, n, g) of each group g.

    A group is dealt to blocks by a hash of the node, and each pair of blocks is a task of its own
    that gives numbers, not pairs: what is written grows with the group's size times its blocks.
    """
    blocks, cell = _cells(nodes.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1"), BLOCK_SETS, BLOCK_SHINGLES)
    dealt = nodes.join(blocks, "g").select("node", "g", "k", _block("node", 11).alias("x")).withColumn("y", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = materialise(dealt.select("node", F.col("g").alias("c"), "x", *cell(F.col("x"), F.col("y"))), "dealt")
    rows = texts(dealt.select("node").distinct()).join(dealt, "node")

    def among(sets: list[np.ndarray]) -> np.ndarray:
        if len(sets) > 8:
            return block_links(sets, None, percent)[0]
        out = np.zeros(len(sets), np.int64)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                k = _shared(x, y)
                if 100 * k >= percent * (len(x) + len(y) - k):
                    out[[i, j]] += 1
        return out

    def tally(t: pa.Table) -> pa.Table:
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)  # rows that repeat an id and its text
        t = t.take(pa.array(first))
        sets, c, x = shingle_sets(t.column("text")), t.column("c").to_numpy(), t.column("x").to_numpy()
        n = np.zeros(len(node), np.int64)
        if not t.column("big")[0].as_py():
            o = np.argsort(c, kind="stable")
            for at in np.split(o, np.flatnonzero(np.diff(c[o])) + 1):
                n[at] = among([sets[i] for i in at])
        elif t.column("i")[0].as_py() == t.column("j")[0].as_py():
            n = block_links(sets, None, percent)[0]
        else:
            own = x == t.column("i")[0].as_py()
            one, two = [s for s, o in zip(sets, own) if o], [s for s, o in zip(sets, own) if not o]
            if one and two:
                n[own], n[~own] = block_links(one, two, percent)
        return pa.table({"node": node, "n_links": n})

    cells = rows.select(*CELL, "c", "x", "node", "text")
    out = cells.groupBy(*CELL).applyInArrow(tally, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    out = materialise(out, "group-links")
    discard(dealt)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, component, set_a, set_b) for every row of docs (doc_id, text, anything else).

    component_id is the smallest doc_id reachable over links of Jaccard similarity of at least
    percent / 100; component tells components apart that have one smallest doc_id, as they may if rows of unlike
    texts repeat an id (null for an empty set); n_links is the number of other classes that the row's class links with; set_a and set_b are the
    digest of its set (0 for an empty one). Null and empty texts, and texts of separators only, have no shingles, link with nothing
    and are their own component. Repeated rows and equal texts are one class. A null doc_id takes
    part through its text, but is never a representative if the class has an id; its component is
    null if it has none. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialise(classes(docs), "classes")
    signs = [f"s{i}" for i in range(SIGNS)]
    groups = known.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "x"))).alias("p"), *[F.min(c).alias(c) for c in signs])
    members = materialise(groups.select(F.col("h1").alias("node"), "h2", "n", F.col("p.doc_id").alias("rep"), F.col("p.x").alias("x"), *signs), "members")
    reps = members.where("rep is not null")
    sizes, total = reps.select("node", "n"), reps.agg(F.sum("n")).first()[0] or 0

    # near copies: each is compared with the smallest node that has one of its least hashes
    sign = reps.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("s")) for i, c in enumerate(signs)])).alias("e")).select("node", "e.i", "e.s")
    lead = sign.groupBy("i", "s").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    keyed = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("x"), "text")

    def first_texts(wanted: DataFrame) -> DataFrame:
        asked = reps.join(wanted, "node").select("node", "rep", "x")
        return _texts_of(keyed, asked.select("rep").distinct(), "rep").join(asked, ["rep", "x"]).select("node", "text")

    near = verify(sign.join(lead, ["i", "s"]).select("a", F.col("node").alias("b")), sizes, first_texts, percent)
    found = connected_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(near)

    # one text for each class, with its component so far
    asked = reps.join(found, F.col("node") == F.col("id"), "left").select("node", "rep", "x", F.coalesce("component", "node").alias("c"))
    base = materialise(keyed.join(asked, ["rep", "x"]).select("node", "c", "text"), "base")

    def texts(wanted: DataFrame) -> DataFrame:
        return _texts_of(base.select("node", "text"), wanted, "node")

    def grown(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The components with the links among these pairs."""
        more = verify(pairs, sizes, texts, percent)
        if more.limit(1).count():
            edges = more.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(found.select(F.col("id").alias("u"), F.col("component").alias("v")))
            was, found = found, connected_components(edges)
            discard(was)
        discard(more)
        return found

    freq = materialise(frequent(base, total), "freq")
    table, cls, heavy = _bounded_table(freq)
    discard(freq)
    shared = spark.sparkContext.broadcast((table, cls))
    light = light_pairs(base, shared, heavy, total, percent)
    lists = materialise(heavy_postings(base, shared, heavy, percent), "heavy")
    best = lists.groupBy("t").agg(F.max(F.struct((F.col("h") / F.col("n")).alias("part"), F.col("node").alias("node"), "n", "h", "c")).alias("p"), F.count("*").alias("m")).where("m > 1").select("t", "p.node", "p.n", "p.h", "p.c")
    star = lists.alias("x").join(best.alias("y"), "t").where(F.expr("x.c <> y.c and " + _may_link("x", "y", percent))).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    found = grown(light.unionByName(star), found)

    # lists that still hold members of several components
    at = lists.drop("c").join(found, F.col("node") == F.col("id"), "left").select("t", "node", "n", "h", F.coalesce("component", "node").alias("c"))
    at = materialise(at, "heavy-at")
    # a list is dealt to blocks by a hash of the node; every two blocks meet in a cell of their own
    mixed = at.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("t", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("k"))
    dealt = at.join(mixed, "t").withColumn("x", F.expr("cast(pmod(xxhash64(node, 7), k) as int)"))
    cells = dealt.withColumn("y", F.explode(F.expr("sequence(0, k - 1)")))
    left, right = cells.withColumn("i", F.col("x")).withColumn("j", F.col("y")), cells.withColumn("i", F.col("y")).withColumn("j", F.col("x"))
    apart = left.alias("x").join(right.alias("y"), ["t", "i", "j"]).where(F.expr("x.c < y.c and " + _may_link("x", "y", percent))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = materialise(apart, "apart")
    if rest.limit(1).count():
        found = grown(rest, found)
    discard(lists, at, rest)

    # links lie within components, where only some of the pairs were needed so far
    linked = materialise(sizes.join(found, F.col("node") == F.col("id")).select("node", "n", F.col("component").alias("g")), "linked")
    counted = group_links(linked, texts, percent)
    discard(base)
    joined = found.join(reps.select("node", "rep"), F.col("id") == F.col("node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    told = joined.join(least, "component").select("node", "component", "least")
    named = members.join(told, "node", "left").join(counted, "node", "left")
    named = named.select(F.col("node").alias("h1"), "h2", "n", F.coalesce("least", "rep").alias("c"), F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = known.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component", F.col("h1").alias("set_a"), F.col("h2").alias("set_b"))
    out = materialise(out, "near")
    discard(known, members, found, linked, counted)
    return out
