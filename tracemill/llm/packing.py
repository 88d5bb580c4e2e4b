"""Packing: optimal length buckets over the global histogram, and token-budget batches inside them.

A dynamic programme over the histogram of all lengths chooses the bucket boundaries that pad
least. Within a bucket every row is padded to the boundary, so a batch holds budget / boundary rows.
Positions within a bucket are exact and global, yet no bucket is ever sorted in one task: rows are
numbered within small parts, and the parts' counts give each part its offset.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.common import materialise, own_name, text_chunks
from tracemill.llm.shingles import word_spans

#: Longest piece, tokens; a longer document is cut into pieces, of which none is dropped.
MAX_TOKENS = 2048
BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 65_536
PART_ROWS = 20_000
#: Equal rows that one run holds.
RUN = 1000


def count_words(texts: pa.Array) -> np.ndarray:
    """Words (runs without white space) of each text; 0 for null."""
    out = np.zeros(len(texts), np.int64)
    for lo, hi, buf, off in text_chunks(texts):
        starts, _ = word_spans(buf, off)
        out[lo:hi] = np.diff(np.searchsorted(starts, off))
    return out


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most buckets length ranges, ascending, with the least total padding.

    lengths are distinct, counts how many rows have each. Ties go to the lower boundary. An empty
    histogram has no bucket.
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    m, k = len(x), min(buckets, len(x))
    c, s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = np.zeros((k + 1, m + 1), np.int64)
    for b in range(1, k + 1):
        new = best.copy()
        back[b] = -1
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            p = int(cost.argmin())
            if cost[p] < new[j]:
                new[j], back[b, j] = cost[p], p
        best = new
    out, j, b = [], m, k
    while j:
        if back[b, j] >= 0:
            out.append(int(x[j - 1]))
            j = int(back[b, j])
        b -= 1
    return out[::-1]


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, text: str = "text", tokens: str | None = None) -> DataFrame:
    """(doc_id, piece, first_token, length): each document as pieces of at most max_tokens tokens.

    Tokens are the text's words, or where tokens names a column (a tokenizer's counts, say), what
    that column says. A null or empty text, or a null count, is one piece of length 0. Repeated rows
    each have their pieces; an empty table gives none.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(count_words(b.column("text")))], names=["doc_id", "n"])

    if tokens is None:
        sized = docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long")
    else:
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(0), F.coalesce(F.col(tokens).cast("long"), F.lit(0))).alias("n"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_tokens)).cast("int"))))
    first = F.col("piece").cast("long") * max_tokens
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_tokens), F.col("n") - first).cast("long").alias("length"))


def pack(items: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """items (doc_id, piece, length, anything else) with bucket, padded_length, batch and slot.

    bucket counts from 0, batch and slot (the place in the batch) from 0 within the bucket. Every
    batch but a bucket's last is full: as many rows as the budget has room for at the bucket's
    padded length, one at least. Rows of length 0 or null need no batch: bucket -1, padded length 0,
    batch and slot null; an empty table gives an empty one; columns of items with the new ones' names are replaced. Lengths above max_tokens raise an error, as they would be cut.
    The histogram has at most max_tokens rows, whatever the input. Batches depend on the rows alone,
    not on how they are partitioned: a hash of the whole row deals rows to parts. Equal rows, which
    nothing tells apart, are counted before they shuffle and dealt in runs, so no id is one task's.
    """
    out = ("bucket", "padded_length", "batch", "slot")
    kept = [c for c in items.columns if c not in out]
    named = [F.col(f"`{c}`") for c in kept]
    n, run, key, part, at, b, p, first = (own_name(items, c) for c in ("_n", "_run", "_key", "_part", "_at", "_b", "_p", "_first"))
    same = items.groupBy(*named).agg(F.count("*").alias(n))
    runs = same.withColumn(run, F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / RUN).cast("int") - 1))).withColumn(n, F.least(F.lit(RUN), F.col(n) - F.col(run) * RUN))
    marked = materialise(runs.withColumn(key, F.to_json(F.struct(*named))), "pieces")
    parts = max(1, math.ceil((marked.agg(F.sum(n)).first()[0] or 0) / PART_ROWS))
    marked = marked.withColumn(part, F.pmod(F.xxhash64(key, run), F.lit(parts)).cast("int"))
    hist = marked.where("length > 0").groupBy("length").agg(F.sum(n).alias("n")).limit(max_tokens + 1).toPandas()
    if len(hist) and hist["length"].max() > max_tokens:
        raise ValueError("a piece is longer than max_tokens")
    bounds = optimal_buckets(hist["length"].to_numpy(), hist["n"].to_numpy(), buckets)
    bucket, padded = F.lit(-1), F.lit(0).cast("long")
    for i, top in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("length") <= top, F.lit(i)).otherwise(bucket)
        padded = F.when(F.col("length") <= top, F.lit(top).cast("long")).otherwise(padded)
    some = F.col("length") > 0
    sorted_in = marked.withColumn("bucket", F.when(some, bucket).otherwise(F.lit(-1))).withColumn("padded_length", F.when(some, padded).otherwise(F.lit(0).cast("long")))
    counts = sorted_in.groupBy("bucket", part).agg(F.sum(n).alias(n))
    before = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias(b), F.col(part).alias(p), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("bucket", part).orderBy("doc_id", "piece", key, run).rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_in.withColumn(at, F.coalesce(F.sum(n).over(within), F.lit(0))).join(offsets, (F.col("bucket") == F.col(b)) & (F.col(part) == F.col(p)))
    start = F.col(first) + F.col(at)
    placed = placed.withColumn(at, F.explode(F.sequence(start, start + F.col(n) - 1)))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_length")))).cast("long")
    used = F.col("bucket") >= 0
    return placed.select(*named, "bucket", "padded_length", F.when(used, F.floor(F.col(at) / room).cast("long")).alias("batch"), F.when(used, (F.col(at) % room).cast("long")).alias("slot"))
