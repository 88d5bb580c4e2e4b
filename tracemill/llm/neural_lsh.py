"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built exactly and cut into balanced parts by recursive
bisection with swaps that lower the cut. A small network learns, from each vector, the parts that
its neighbours lie in. Every row of the table is indexed under its most probable part; a query is
sent to its most probable parts, as many as the sample shows to be needed, and reranked there by
the exact measure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.common import discard, materialise
from tracemill.llm.vectors import BLOCK_ROWS, NEIGHBOURS, PASS_QUERIES, QUERY_STEP, clean, dense, in_passes, own_rows

#: Bound on the sample that the partition is learned from.
SAMPLE = 8192
#: Rows that a part should hold while parts can still grow in number, and the most parts that the sample can tell apart (8 of its rows each).
PART_ROWS, PARTS_MOST = 1600, SAMPLE // 8
GRAPH_DEGREE = 10
HIDDEN = 64
EPOCHS = 30
#: Share of true neighbours that the sample must reach; more than the 0.9 asked for.
TARGET = 0.96


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The degree nearest rows of each row, by inner product, in blocks."""
    out = np.zeros((len(x), min(degree, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else out[a : a + 512]
    return out


def _bisect(x: np.ndarray, rows: np.ndarray, near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Side (0 or 1) of each row: halves along the main direction, then swaps that lower the cut."""
    part = x[rows] - x[rows].mean(axis=0)
    _, _, axes = np.linalg.svd(part[: min(len(part), 2048)], full_matrices=False)
    side = np.zeros(len(rows), np.int64)
    side[np.argsort(part @ axes[0], kind="stable")[len(rows) // 2 :]] = 1
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    a = np.repeat(np.arange(len(rows)), near.shape[1])
    b = place[near[rows].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(rounds):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), len(rows))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        n = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        n = max(0, n // 2) if n > 1 else n  # half of them: swaps change each other's gains
        if not n:
            break
        side[left[:n]], side[right[:n]] = 1, 0
    return side


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row; parts is a power of two, sizes differ by few rows."""
    out = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(parts))):
        new = out * 2
        for p in range(out.max() + 1 if len(out) else 0):
            rows = np.flatnonzero(out == p)
            if len(rows) > 1:
                new[rows] += _bisect(x, rows, near)
        out = new
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size before."""
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0.0, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def learn(x: np.ndarray, parts: int = 32, k: int = NEIGHBOURS, seed: int = 9) -> Router:
    """Cut the sample's neighbour graph, fit the classifier, and set how many parts a query needs."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 and len(x) else 1
    x = x / max(float(np.abs(x).max(initial=0.0)), 1e-300)  # one scale for all keeps the order of inner products
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    net = Router(rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts), parts)
    if parts == 1:
        return net
    near = neighbour_graph(x, GRAPH_DEGREE)
    part = balanced_parts(x, near, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 0.5 / near.shape[1])
    soft[np.arange(len(x)), part] += 0.5
    unit = _unit(x)
    names = ("w1", "b1", "w2", "b2")
    m1, m2, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            h = np.maximum(unit[i] @ net.w1 + net.b1, 0)
            d = (net.probabilities(x[i]) - soft[i]) / len(i)
            dh = (d @ net.w2.T) * (h > 0)
            grads = {"w1": unit[i].T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum(0)}
            t += 1
            for n, g in grads.items():
                m1[n], m2[n] = 0.9 * m1[n] + 0.1 * g, 0.99 * m2[n] + 0.01 * g * g
                setattr(net, n, getattr(net, n) - 0.01 * (1 - epoch / EPOCHS) * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.99**t)) + 1e-8))
    # how many parts must be looked at, so that the sample's own queries find TARGET of their neighbours
    ask = rng.permutation(len(x))[:1024]
    home = net.probabilities(x).argmax(axis=1)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -np.inf
    true = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-net.probabilities(x[ask]), axis=1), axis=1)
    needed = np.take_along_axis(rank, home[true], axis=1)
    reach = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    net.probes = int(min(parts, np.searchsorted(reach, TARGET) + 1))
    return net


def best_of_block(ids: np.ndarray, keys: np.ndarray, n: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q_keys: np.ndarray, q: np.ndarray, k: int):
    """(query row, id, over, score, big, n) of each query's k nearest rows of a block, its own row left out once.

    Scores are sums in the order of the components, so that equal vectors have equal scores in every
    block; the matrix product before only narrows the choice, by more than it can be off. A sum that
    is no number (of opposite infinities) is the least of all: over is -1.
    """
    mine = own_rows(ids, keys, q_ids, q_keys)
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        longest = np.linalg.norm(x, axis=1).max(initial=0.0)
        for a in range(0, len(q_ids), 256):
            qv, own = q[a : a + 256], mine[a : a + 256]
            s = qv @ x.T
            s[np.isnan(s)] = -np.inf
            gone = np.zeros(s.shape, bool)
            j = np.flatnonzero(own >= 0)
            gone[j, own[j]] = n[own[j]] == 1
            m = min(k, s.shape[1])
            bar = -np.partition(-np.where(gone, -np.inf, s), m - 1, axis=1)[:, m - 1]
            slack = 1e-15 * x.shape[1] * np.linalg.norm(qv, axis=1) * longest
            slack[np.isnan(slack)] = np.inf
            low = bar - 2 * slack
            low[np.isnan(low)] = -np.inf
            r, c = np.nonzero(((s >= low[:, None]) | ~(np.abs(s) < 1e300)) & ~gone)
            score = np.cumsum(qv[r] * x[c], axis=1)[:, -1]
            over = np.where(np.isnan(score), -1, 0)
            o = np.lexsort((ids[c], np.where(over, 0, -score), -over, r))
            r, c, score, over = r[o], c[o], score[o], over[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[keep], c[keep]
            out.append((a + r, ids[c], over[keep], score[keep], np.full(len(r), None, object), n[c] - (c == own[r])))
    return tuple(np.concatenate(z) for z in zip(*out))


def fit(vectors: DataFrame, rows: int, dim: int, sample: int = SAMPLE) -> Router:
    """A router learned on at most sample vectors, which a hash of the row picks."""
    got = vectors.select("vec_id", "key", "v").orderBy(F.xxhash64("vec_id", "key", F.lit(17)), "vec_id", "key").limit(sample).toArrow()
    return learn(dense(got.column("v"), dim), parts_for(rows))


def parts_for(rows: int) -> int:
    """Parts grow with the table, by powers of two, as far as the bounded sample can tell them apart."""
    return min(PARTS_MOST, max(8, 1 << max(0, round(math.log2(max(1, rows) / PART_ROWS)))))


def by_home(homes: dict[int, int], most: int = PASS_QUERIES) -> list:
    """Filters that deal queries to passes: those of one home part together, of neighbouring parts while there is room."""
    out, together, room = [], [], most
    for p, n in sorted(homes.items()):
        if n > most:
            cuts = math.ceil(n / most)
            out += [(F.col("parts")[0] == p) & (F.pmod(F.xxhash64("vec_id", "key", F.lit(3)), F.lit(cuts)) == c) for c in range(cuts)]
            continue
        if n > room:
            out.append(F.col("parts")[0].isin(together))
            together, room = [], most
        together, room = [*together, p], room - n
    return [*out, F.col("parts")[0].isin(together)] if together or not out else out


INDEX = "part int, block int, ids binary, keys binary, n binary, x binary"


def nearest(table: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows that were found.

    Queries are the rows whose id is divisible by step, candidates all rows but the query's own.
    Vectors null, zero, or with null or non-finite components take no part. Vectors of unlike
    lengths meet in the positions that both have. Every row is indexed, once, in blocks of its most
    probable part; a query meets all blocks of its most probable parts. Rows that repeat an id are
    rows of their own: each is a candidate for the others, and each query row has its k results,
    under the same query_id. A score that overflows is infinite, or no number and then last. Parts are
    asked until they have k candidates, so few candidates are all returned; an empty table has none.
    """
    vectors = materialise(clean(table, zero=False), "vectors")
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    net = fit(vectors, rows, dim)
    shared = vectors.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*vectors.schema.fields, T.StructField("parts", T.ArrayType(T.IntegerType()))])

    def route(batches):
        m = shared.value
        for b in batches:
            order = np.argsort(-m.probabilities(dense(b.column("v"), dim)), axis=1, kind="stable").astype(np.int32)
            ask = b.column("vec_id").to_numpy() % step == 0
            size = np.where(ask, order.shape[1], 1)  # only a query needs more than its home
            flat = order[np.arange(order.shape[1]) < size[:, None]]
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, parts], names=[*b.schema.names, "parts"])

    routed = materialise(vectors.mapInArrow(route, schema), "routed")
    sizes = {r["p"]: r["n"] for r in routed.groupBy(F.col("parts")[0].alias("p")).agg(F.count("*").alias("n")).collect()}  # at most PARTS_MOST rows
    blocks = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, max(1, math.ceil(n / BLOCK_ROWS)))]) if sizes else F.create_map(F.lit(-1), F.lit(1))
    homed = routed.withColumn("part", F.col("parts")[0]).withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.try_element_at(blocks, F.col("part"))).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        ids, keys, n = (t.column(c).to_numpy() for c in ("vec_id", "key", "n"))
        o = np.lexsort((keys, ids))
        raw = [pa.array([x[o].tobytes()], pa.binary()) for x in (ids, keys, n, dense(t.column("v"), dim))]
        return pa.table([*(pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("part", "block")), *raw], names=[f.split()[0] for f in INDEX.split(", ")])

    # a folder for each part, so that a pass reads the parts that it asks for
    index = materialise(homed.groupBy("part", "block").applyInArrow(pack, INDEX), "index", by=["part"])

    count = np.zeros(max(sizes, default=0) + 1, np.int64)
    count[list(sizes)] = list(sizes.values())
    least = net.probes

    def asked(q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each query in its order, and which of them it asks: as many as the router has found to be needed, and more where they have too few rows."""
        order = np.array(q.column("parts").to_pylist(), np.int64).reshape(q.num_rows, -1)
        rows_before = np.cumsum(np.where(order < len(count), count[np.minimum(order, len(count) - 1)], 0), axis=1)
        return order, (np.arange(order.shape[1]) < least) | (np.concatenate([np.zeros((len(order), 1), np.int64), rows_before[:, :-1]], axis=1) <= k)

    def wanted(q: pa.Table) -> list[int]:
        if not q.num_rows:
            return []
        order, ask = asked(q)
        return sorted(set(np.unique(order[ask]).tolist()) & set(sizes))

    def search(block: dict, q: pa.Table):
        order, ask = asked(q)
        who = np.flatnonzero(((order == block["part"]) & ask).any(axis=1))
        if not len(who):
            return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.float64, object, np.int64))
        ids, keys, n = (np.frombuffer(block[c], np.int64) for c in ("ids", "keys", "n"))
        some = q.take(pa.array(who))
        at, *rest = best_of_block(ids, keys, n, np.frombuffer(block["x"]).reshape(len(ids), dim), some.column("vec_id").to_numpy(), some.column("key").to_numpy(), dense(some.column("v"), dim), k)
        return who[at], *rest

    queries = routed.where(F.col("vec_id") % step == 0)
    homes = {r["p"]: r["n"] for r in queries.groupBy(F.col("parts")[0].alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each part
    out = in_passes(index, queries, k, "double", search, by_home(homes), wanted)
    discard(vectors, routed, index)
    return out
