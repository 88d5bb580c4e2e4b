"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax.

Features of a text are its words and each word's n-grams of three and four bytes (letters of most
scripts are one to three bytes; white space at either end marks a word's border), hashed into a
table of learned vectors. One further vector, which the method's plain form lacks, stands for a
word that repeats the one before it. A document is the mean of its features' vectors; a softmax
over that mean gives the label. Training is plain numpy
stochastic gradient descent on a bounded sample of labelled rows. As the output is linear in the
mean, each feature's vector is projected once after training, and scoring sums one number for
each feature of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.common import extended, held_out, labelled_sample, per_text_sums, text_chunks
from tracemill.llm.shingles import word_hashes

BITS = 16
DIM = 8
#: Bound on the training sample, rows of each label.
PER_CLASS = 1500
#: Passes over the sample, more where it is small: at least STEPS steps.
EPOCHS, STEPS = 4, 3000
RATE = 1.0
_SIZE = 1 << BITS
#: words, trigrams, 4-grams each have a table of their own; one slot marks repeated words
_SLOTS = 3 * _SIZE + 1
_K3, _K4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigram and 4-gram that begin at each byte, and whether each lies within a word and its borders."""
    white = _WHITE[buf]
    b = np.where(white, 32, buf).astype(np.uint32)
    with np.errstate(over="ignore"):
        tri = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16)) if len(b) > 2 else b[:0]
        quad = tri[:-1] | (b[3:] << np.uint32(24)) if len(b) > 3 else b[:0]
        inner = ~white[1:-1]
        return (tri * _K3) >> np.uint32(32 - BITS), (quad * _K4) >> np.uint32(32 - BITS), inner[: len(tri)], (inner[:-1] & inner[1:])[: len(quad)]


def _features(texts: pa.Array):
    """For each run of texts: the slots of each kind and the ranges that belong to each text."""
    for lo, hi, buf, off in text_chunks(texts):
        h, at = word_hashes(buf, off)
        tri, quad, in3, in4 = _grams(buf)
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[1:] = h[1:] == h[:-1]
            inner = at[:-1][at[:-1] < len(h)]
            same[inner] = False
        ends = [np.maximum(off[:-1], off[1:] - k) for k in (2, 3)]
        yield lo, hi, off, at, (h >> np.uint64(64 - BITS)).astype(np.int64), (tri, in3), (quad, in4), same, ends


@dataclass
class SubwordModel:
    """slot: score of each feature; bias: what an empty text gets."""

    slot: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; a null or empty text gets the prior."""
        out = np.zeros(len(texts))
        word, tri_s, quad_s, twin = self.slot[:_SIZE], self.slot[_SIZE : 2 * _SIZE], self.slot[2 * _SIZE : 3 * _SIZE], float(self.slot[-1])
        for lo, hi, off, at, w, tri, quad, same, ends in _features(texts):
            total = per_text_sums(word[w], at) + twin * per_text_sums(same, at)
            n = np.diff(at) + per_text_sums(same, at)
            for s, (idx, inside), end in ((tri_s, tri, ends[0]), (quad_s, quad, ends[1])):
                run, count = np.zeros(len(idx) + 1), np.zeros(len(idx) + 1, np.int64)
                np.cumsum(s[idx] * inside, out=run[1:])
                np.cumsum(inside, out=count[1:])
                a, b = np.minimum(off[:-1], len(idx)), np.minimum(end, len(idx))
                total += run[b] - run[a]
                n += count[b] - count[a]
            z = np.clip(self.bias + total / np.maximum(n, 1), -40, 40)
            out[lo:hi] = 1 / (1 + np.exp(-z))
        return out


def train(texts: pa.Array, y: np.ndarray, prior: float, seed: int = 3) -> SubwordModel:
    """Fit by SGD; prior is the share of label 1 among all labels, which the sample may not have."""
    rng = np.random.default_rng(seed)
    bags = []
    for lo, hi, off, at, w, tri, quad, same, ends in _features(texts):
        for i in range(hi - lo):
            grams = [idx[off[i] : end[i]][inside[off[i] : end[i]]] + np.int64(k * _SIZE) for k, (idx, inside), end in ((1, tri, ends[0]), (2, quad, ends[1]))]
            f = np.concatenate([w[at[i] : at[i + 1]], *grams, np.full(int(same[at[i] : at[i + 1]].sum()), _SLOTS - 1)])
            u, n = np.unique(f, return_counts=True)
            bags.append((u, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (_SLOTS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if len(bags) and 0 < y.sum() < len(y):
        epochs = max(EPOCHS, -(-STEPS // len(bags)))
        steps = epochs * len(bags)
        for k in range(epochs):
            for j, i in enumerate(rng.permutation(len(bags))):
                rate = RATE * (1 - (k * len(bags) + j) / steps)
                u, share = bags[i]
                hidden = share @ vectors[u] if len(u) else np.zeros(DIM, np.float32)
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = out @ p
                out -= rate * np.outer(hidden, p)
                bias -= 0.1 * rate * p
                # the mean's gradient, scaled so that a feature's step doesn't vanish with the length
                vectors[u] -= (rate * 8) * np.outer(share, back).astype(np.float32)
    share1 = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(share1 / (1 - share1))
    return SubwordModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> SubwordModel:
    """Train on a bounded sample of the labelled rows outside the held-out fold."""
    texts, y = labelled_sample(docs, labels, label, per_class)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(texts, y, 0.5 if known is None else known)


def score_documents(docs: DataFrame, model: SubwordModel, threshold: float = 0.3, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with two more columns: score double and predicted int (1 if score >= threshold).

    Every row is kept, null and empty texts too (they get the prior), repeated rows alike; an empty table gives an
    empty one. Columns of docs that have
    the new columns' names are replaced. Nothing but the text is read for the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (score, predicted)]
    base = docs.select(*kept)
    schema = extended(base, **{score: T.DoubleType(), predicted: T.IntegerType()})

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.score(b.column(b.schema.get_field_index(text)))
            cols = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*b.schema.names, score, predicted])

    return base.mapInArrow(run, schema)
