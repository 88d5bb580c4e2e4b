"""Vector tables for search: cleaning, and groups of queries that pass over an index of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.common import discard, materialise

#: One query in so many: the searches' stated query set.
QUERY_STEP = 20
NEIGHBOURS = 20
#: Queries that one pass over the index takes along; their vectors are broadcast, so the bound is one of memory.
PASS_QUERIES = 32768
#: Rows that one block of an index should hold.
BLOCK_ROWS = 4096
FOUND = "query_id long, q_key long, vec_id long, over int, score {score}, big string, n long"


def clean(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id long, v array<double>, key long, n long) of the vectors that take part.

    Rows with a null id, and vectors null or with a null or non-finite component, are left out, and
    zero vectors (empty ones too) unless zero is set. n counts equal rows, which are one here and are
    told apart again in the results; they are aggregated before they shuffle, so a hot row is no
    group. key tells the vectors of one id apart.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    # 0.0 + x makes no difference but for the sign of zero
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.xxhash64("v").alias("key"), "n")


def dense(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim).astype(dtype, copy=False)
    out = np.zeros((len(size), dim), dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def own_rows(ids: np.ndarray, keys: np.ndarray, q_ids: np.ndarray, q_keys: np.ndarray) -> np.ndarray:
    """Row of each query among rows in order of (id, key), or -1; a row is one vector of one id."""
    out = np.full(len(q_ids), -1, np.int64)
    lo, hi = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
    for j in np.flatnonzero(hi > lo):
        at = lo[j] + int(np.searchsorted(keys[lo[j] : hi[j]], q_keys[j]))
        if at < hi[j] and keys[at] == q_keys[j]:
            out[j] = at
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks found for each query, equal rows counted out: rank 1 is the best.

    A score beyond the range of its type (over is 1 above, -1 below) is ordered by big. Ties go to
    the smaller id. A query has at most k rows of each task, which bounds the window's groups.
    """
    w = Window.partitionBy("query_id", "q_key").orderBy(F.col("over").desc(), F.col("score").desc(), F.col("big").desc(), F.col("vec_id"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the row number alone is at most the rank, which lets Spark drop rows before they are shuffled
    some = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    ranked = some.withColumn("_b", before).where(F.col("_b") < k)
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k) - F.col("_b"))))
    return ranked.withColumn("_i", each).select("query_id", "q_key", (F.col("_b") + F.col("_i")).cast("int").alias("rank"), "vec_id", "score")


def in_passes(index: DataFrame, queries: DataFrame, k: int, score: str, search: Callable, deal: list | None = None, wanted: Callable | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of an index of blocks.

    queries has (vec_id, v, key, n, anything else). They are dealt to groups of about PASS_QUERIES, by a hash or by the
    filters of deal; each group is broadcast and passes once over the blocks, where they lie, all of them or those whose part is in wanted(queries): search(block as a dict,
    queries as a table) gives arrays of (query row, ids, over, score, big, n). A task keeps the k best that its blocks
    have for each query, so what is shuffled grows with queries and tasks, never with the index.
    """
    spark = index.sparkSession
    if deal is None:
        groups = max(1, math.ceil(queries.count() / PASS_QUERIES))
        deal = [F.pmod(F.xxhash64("vec_id", "key"), F.lit(groups)) == g for g in range(groups)]
    parts = []
    for group in deal:
        asked = queries.where(group).toArrow()
        blocks = index if wanted is None else index.where(F.col("part").isin(wanted(asked)))
        shared = spark.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            q = shared.value
            q_ids, q_keys = q.column("vec_id").to_numpy(), q.column("key").to_numpy()
            held: tuple | None = None
            for b in batches:
                for block in b.to_pylist():
                    new = search(block, q)
                    if held is not None:
                        new = tuple(np.concatenate(z) for z in zip(held, new))
                    held = _keep(*new, k)
            if held is not None:
                at, ids, over, value, big, n = held
                kind = pa.int64() if score == "long" else pa.float64()
                for lo in range(0, len(at), 100_000):
                    s = slice(lo, lo + 100_000)
                    cols = [pa.array(q_ids[at[s]]), pa.array(q_keys[at[s]]), pa.array(ids[s]), pa.array(over[s], pa.int32()), pa.array(value[s], kind), pa.array(big[s].tolist(), pa.string()), pa.array(n[s])]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "q_key", "vec_id", "over", "score", "big", "n"])

        found = blocks.mapInArrow(run, FOUND.format(score=score))
        parts.append(materialise(best_of(found, k), "found"))
        shared.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    done = asked_again(out, queries)
    discard(*parts)
    return done


def asked_again(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with a row for each time that the table has the query's row."""
    again = queries.where("n > 1").select(F.col("vec_id").alias("_q"), F.col("key").alias("_k"), "n")
    times = found.join(again, (F.col("query_id") == F.col("_q")) & (F.col("q_key") == F.col("_k")), "left")
    return materialise(times.withColumn("_t", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))).select("query_id", "rank", "vec_id", "score"), "nearest")


def _keep(at: np.ndarray, ids: np.ndarray, over: np.ndarray, value: np.ndarray, big: np.ndarray, n: np.ndarray, k: int) -> tuple:
    """The k best rows of each query, in the order of best_of."""
    if len(at):
        # big only orders what is out of range, which is rare
        far = np.array([b or "" for b in big[over != 0]]) if (over != 0).any() else None
        deep = np.zeros(len(at), np.int64)
        if far is not None:
            deep[over != 0] = np.unique(far, return_inverse=True)[1] + 1
        o = np.lexsort((ids, -deep, -value if value.dtype.kind == "f" else ~value, -over, at))
        at, ids, over, value, big, n = (x[o] for x in (at, ids, over, value, big, n))
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        at, ids, over, value, big, n = (x[keep] for x in (at, ids, over, value, big, n))
    return at, ids, over, value, big, n
