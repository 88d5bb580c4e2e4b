"""Exact top-k by inner product on a bit-sliced index.

Components are quantised to integers and stored, block by block, as bitmaps: one bitmap of rows for
each bit of each attribute. A query's score is a weighted sum of attributes; it is added up on whole
bitmaps with full adders (three bitmaps of one weight become a sum and a carry), which gives the
slices of the score. The top rows are picked from the most significant slice downward: rows that
are certain, rows that are still level. What is level at the end is the boundary, where the
smaller ids win; exact scores are read off the slices. The index is written once; groups of queries
pass over its blocks where they lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import discard, materialise
from tracemill.llm.vectors import NEIGHBOURS, QUERY_STEP, clean, dense, in_passes, own_rows

SCALE = 64
#: Rows that one block of the index should hold: bitmaps long enough that adding them outweighs calling numpy.
BLOCK_ROWS = 16384
#: Queries that are added up together.
ADDED_QUERIES = 4
#: Components up to this size after scaling are sliced; rows and queries with larger ones are exact whole numbers.
LARGEST = 1 << 24
_NINES = str.maketrans("0123456789", "9876543210")


def build_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(planes, least, bits): bitmaps of x - least, dim x bits x words, rows from the low bit up."""
    n, dim = x.shape
    least = x.min(axis=0)
    u = x - least
    bits = max(1, int(u.max()).bit_length())
    words = -(-n // 64)
    planes = np.zeros((dim, bits, words * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits((u >> j & 1).astype(np.uint8), axis=0, bitorder="little")
        planes[:, j, : packed.shape[0]] = packed.T
    return planes.view(np.uint64), least, bits


def add_slices(planes: np.ndarray, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slices of each query's score (plus what negative weights shift), from the low one up.

    A negative weight takes the complement's bitmaps: -x = (full - x) - full. Returns the slices,
    each (queries, words), and for each query how far the sum is above the inner product with
    the shifted attributes.
    """
    dim, bits, words = planes.shape
    flat = np.concatenate([planes.reshape(-1, words), ~planes.reshape(-1, words), np.zeros((1, words), np.uint64)])
    none = len(flat) - 1
    size = np.abs(queries)
    shift = np.where(queries < 0, size, 0).sum(axis=1) * ((1 << bits) - 1)
    at: list[list[list[int]]] = []
    top = int(size.max(initial=0)).bit_length() + bits
    base = np.arange(dim) * bits
    for w in range(top):
        level = []
        for q in range(len(queries)):
            rows = [base[on] + j + np.where(queries[q][on] < 0, dim * bits, 0) for j in range(max(0, w - top), min(bits, w + 1)) if len(on := np.flatnonzero(size[q] >> (w - j) & 1))]
            level.append(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        at.append(level)
    slices, carried, w = [], np.zeros((len(queries), 0, words), np.uint64), 0
    while w < top or carried.shape[1]:
        if w < top:
            most = max(len(r) for r in at[w])
            idx = np.full((len(queries), most), none)
            for q, r in enumerate(at[w]):
                idx[q, : len(r)] = r
            cur = np.concatenate([flat[idx], carried], axis=1)
        else:
            cur = carried
        carry = []
        while cur.shape[1] > 2:
            m = cur.shape[1] // 3 * 3
            a, b, c = cur[:, 0:m:3], cur[:, 1:m:3], cur[:, 2:m:3]
            half = a ^ b
            carry.append((a & b) | (c & half))
            cur = np.concatenate([half ^ c, cur[:, m:]], axis=1)
        if cur.shape[1] == 2:
            carry.append(cur[:, :1] & cur[:, 1:])
            cur = cur[:, :1] ^ cur[:, 1:]
        slices.append(cur[:, 0] if cur.shape[1] else np.zeros((len(queries), words), np.uint64))
        carried = np.concatenate(carry, axis=1) if carry else np.zeros((len(queries), 0, words), np.uint64)
        w += 1
    return slices, shift


def pick_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(certain, level) bitmaps of each query: certain rows are in, as many level ones as are missing."""
    sure, level = np.zeros_like(valid), valid.copy()
    done = np.bitwise_count(level).sum(axis=1) <= k
    sure[done], level[done] = level[done], 0
    for s in reversed(slices):
        both = sure | (level & s)
        n = np.bitwise_count(both).sum(axis=1)
        over, under, even = n > k, n < k, n == k
        level[over] &= s[over]
        sure[under] = both[under]
        level[under] &= ~s[under]
        sure[even], level[even] = both[even], 0
    return sure, level


def sortable(x: int) -> str:
    """A whole number of any size as text that sorts like the number."""
    digits = str(abs(x))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if x >= 0 else "0" + text.translate(_NINES)


def exact_integers(v: np.ndarray) -> list[int]:
    """floor(SCALE * x) of each double, exactly."""
    return [int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in v.tolist()]


def index_block(ids: np.ndarray, keys: np.ndarray, n: np.ndarray, x: np.ndarray) -> dict:
    """One block of the index: rows in order of (id, key), those within LARGEST as bitmaps, the others as doubles."""
    o = np.lexsort((keys, ids))
    ids, keys, n, x = ids[o], keys[o], n[o], x[o]
    with np.errstate(over="ignore"):
        wide = (np.abs(x) * SCALE > LARGEST).any(axis=1)
    out = {"wide_ids": ids[wide].tobytes(), "wide_keys": keys[wide].tobytes(), "wide_n": n[wide].tobytes(), "wide_x": x[wide].tobytes()}
    ids, keys, n, x = ids[~wide], keys[~wide], n[~wide], x[~wide]
    planes, least, bits = build_block(np.floor(x * SCALE).astype(np.int64)) if len(x) else (np.zeros((x.shape[1], 1, 0), np.uint64), np.zeros(x.shape[1], np.int64), 1)
    return out | {"ids": ids.tobytes(), "keys": keys.tobytes(), "n": n.tobytes(), "planes": planes.tobytes(), "least": least.tobytes(), "bits": bits}


def _sliced(planes: np.ndarray, least: np.ndarray, count: int, own: np.ndarray, queries: np.ndarray, k: int):
    """(query row, row, score) of each query's k best rows by slices; own is a row to leave out, or -1."""
    words = planes.shape[2]
    full = np.zeros(words * 8, np.uint8)
    bits = np.packbits(np.ones(count, np.uint8), bitorder="little")
    full[: len(bits)] = bits
    full = full.view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), ADDED_QUERIES):
        q = queries[a : a + ADDED_QUERIES]
        slices, shift = add_slices(planes, q)
        valid = np.repeat(full[None], len(q), axis=0)
        for j, p in enumerate(own[a : a + ADDED_QUERIES]):
            if p >= 0:
                valid[j, p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure, level = pick_top(slices, valid, k)
        base = q @ least - shift
        for j in range(len(q)):
            rows = np.flatnonzero(np.unpackbits(sure[j].view(np.uint8), bitorder="little"))
            # level rows share all slices; rows are in order of their ids, so the first ones are the boundary's
            more = np.flatnonzero(np.unpackbits(level[j].view(np.uint8), bitorder="little"))[: k - len(rows)]
            rows = np.concatenate([rows, more])
            w, b = rows >> 6, (rows & 63).astype(np.uint64)
            score = np.zeros(len(rows), np.int64)
            for t, s in enumerate(slices):
                score += (s[j, w] >> b & np.uint64(1)).astype(np.int64) << t
            out.append((np.full(len(rows), a + j), rows, score + base[j]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*out))


def search_block(block: dict, q_ids: np.ndarray, q_keys: np.ndarray, qx: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, over, score, big, n) of each query's k best rows of a block, its own row left out once.

    Rows and queries within LARGEST meet in the slices. The others, and all that such a query meets,
    are exact whole numbers of any size; a score beyond a long is cut to it, over tells which way,
    and big keeps its order.
    """
    ids, keys, n, least = (np.frombuffer(block[c], np.int64) for c in ("ids", "keys", "n", "least"))
    dim = qx.shape[1]
    planes = np.frombuffer(block["planes"], np.uint64).reshape(dim, block["bits"], -1)
    with np.errstate(over="ignore"):
        plain = ~(np.abs(qx) * SCALE > LARGEST).any(axis=1)
    mine = own_rows(ids, keys, q_ids, q_keys)
    alone = mine.copy()
    if len(n):
        alone[(mine >= 0) & (n[mine] > 1)] = -1  # its copies are candidates
    at, rows, score = (np.zeros(0, np.int64),) * 3
    who = np.flatnonzero(plain)
    if len(ids) and len(who):
        at, rows, score = _sliced(planes, least, len(ids), alone[who], np.floor(qx[who] * SCALE).astype(np.int64), k)
        at = who[at]
    out = [(at, ids[rows], np.zeros(len(at), np.int64), score, np.full(len(at), None, object), n[rows] - (rows == mine[at]))]
    w_ids, w_keys, w_n = (np.frombuffer(block[c], np.int64) for c in ("wide_ids", "wide_keys", "wide_n"))
    if len(w_ids) or not plain.all():
        out.append(_any_size(block, planes, least, (ids, keys, n), (w_ids, w_keys, w_n), q_ids, q_keys, qx, plain, k))
    return tuple(np.concatenate(z) for z in zip(*out))


def _any_size(block, planes, least, slim, wide, q_ids, q_keys, qx, plain, k):
    """What the slices don't reach: wide rows for all queries, all rows for wide queries."""
    ids, keys, n = (np.concatenate(z) for z in zip(slim, wide))
    bit = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little")[:, :, : len(slim[0])].astype(np.int64)
    small = (bit << np.arange(planes.shape[1])[None, :, None]).sum(axis=1).T + least
    vectors = [*small.tolist(), *(exact_integers(r) for r in np.frombuffer(block["wide_x"], np.float64).reshape(-1, qx.shape[1]))]
    got = []
    for j in range(len(q_ids)):
        q = exact_integers(qx[j])
        found = []
        for r in range(len(slim[0]) if plain[j] else 0, len(ids)):
            times = int(n[r]) - int(ids[r] == q_ids[j] and keys[r] == q_keys[j])
            if times > 0:
                found.append((-sum(a * b for a, b in zip(q, vectors[r])), int(ids[r]), times))
        got += [(j, i, -s, t) for s, i, t in sorted(found)[:k]]
    top = 2**63 - 1
    over = [1 if s > top else -1 if s < -top - 1 else 0 for _, _, s, _ in got]
    score = np.array([min(top, max(-top - 1, s)) for _, _, s, _ in got], np.int64)
    big = np.empty(len(got), object)
    big[:] = [sortable(s) if o else None for (_, _, s, _), o in zip(got, over)]
    whole = lambda c: np.array([g[c] for g in got], np.int64)
    return whole(0), whole(1), np.array(over, np.int64), score, big, whole(3)


INDEX = "block int, ids binary, keys binary, n binary, planes binary, least binary, bits int, wide_ids binary, wide_keys binary, wide_n binary, wide_x binary"


def build_index(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """One row for each block of about BLOCK_ROWS rows; every row is in one block, which a hash of it picks."""
    blocks = max(1, math.ceil(rows / BLOCK_ROWS))

    def pack(t: pa.Table) -> pa.Table:
        made = index_block(t.column("vec_id").to_numpy(), t.column("key").to_numpy(), t.column("n").to_numpy(), dense(t.column("v"), dim))
        names = [f.split()[0] for f in INDEX.split(", ")]
        made["block"] = int(t.column("b")[0].as_py())
        return pa.table({c: pa.array([made[c]], pa.int32() if c in ("block", "bits") else pa.binary()) for c in names})

    return vectors.withColumn("b", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(pack, INDEX)


def top_k(table: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by the inner product of floor(64 * x).

    Queries are the rows whose id is divisible by step, candidates all rows but the query's own; all
    rows are indexed once and all scores exact, whatever their size. Vectors null or with null or
    non-finite components take no part; zero and empty ones do. Vectors of unlike lengths meet in
    the positions that both have. Rows that repeat an id are rows of their own: each is a candidate for
    the others, and each query row has its k results, under the same query_id. A score beyond a
    long is given as the nearest long, in its true order. Fewer than k candidates are all returned;
    an empty table gives an empty result.
    """
    vectors = materialise(clean(table, zero=True), "vectors")
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    index = materialise(build_index(vectors, dim, rows), "index")

    def search(block: dict, q: pa.Table):
        return search_block(block, q.column("vec_id").to_numpy(), q.column("key").to_numpy(), dense(q.column("v"), dim), k)

    out = in_passes(index, vectors.where(F.col("vec_id") % step == 0), k, "long", search)
    discard(vectors, index)
    return out
