"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes have learned vectors; filters of several widths slide over windows of fixed length, each
filter's largest response in a window is kept, and a softmax over these gives the window's
language. A document's log-probabilities are the sum over all its windows, weighted by their
bytes and tempered by the root of their number, as neighbouring windows are not independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tracemill.llm.common import bounded_texts, extended, held_out, per_text_sums, text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
#: Bound on the training sample: texts of each language, and windows of each language.
TEXTS_PER_LANG = 400
WINDOWS_PER_LANG = 2500
#: Parts that a language's rows are dealt to before the sample is picked.
SLOTS = 64
EPOCHS = 6
BATCH = 64
RATE = 0.01
#: What a text without letters, or a null one, is said to be in.
UNKNOWN = "und"
_TOP = max(WIDTHS)
_STEP = WINDOW - _TOP + 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as bytes with zeros after a text's end, text of each, bytes of each)."""
    size = np.diff(off)
    n = np.maximum(1, -(-(size - _TOP + 1) // _STEP)) * (size > 0)
    of = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = off[:-1][of] + k * _STEP
    left = np.minimum(WINDOW, off[1:][of] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < left[:, None]
    return np.where(inside, buf[np.minimum(at, max(0, len(buf) - 1))], 0).astype(np.uint8), of, left


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; false for null."""
    out = np.zeros(len(texts), bool)
    for lo, hi, buf, off in text_chunks(texts):
        out[lo:hi] = per_text_sums(_LETTER[buf], off) > 0
    for i in np.flatnonzero(~out):
        t = texts[int(i)].as_py()
        out[i] = bool(t) and any(c.isalpha() for c in t)
    return out


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # (_TOP * DIM) x (FILTERS * len(WIDTHS)), zero beyond a filter's width
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, win: np.ndarray) -> np.ndarray:
        x = self.embed[win]
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(win), _STEP, _TOP * DIM), (s[0], s[1], s[2])).reshape(-1, _TOP * DIM)

    def probabilities(self, win: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        out = np.zeros((len(win), len(self.langs)))
        for a in range(0, len(win), 64):
            part = win[a : a + 64]
            y = (self._columns(part) @ self.conv).reshape(len(part), _STEP, -1).max(axis=1)
            z = np.maximum(y + self.conv_bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + 64] = z / z.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text; UNKNOWN with 0 where there is no letter."""
        c = len(self.langs)
        total, size = np.zeros((len(texts), c)), np.zeros(len(texts))
        for lo, hi, buf, off in text_chunks(texts):
            if len(buf):
                win, of, left = windows(buf, off)
                p = np.log(np.maximum(self.probabilities(win), 1e-6)) * (left[:, None] / WINDOW)
                size[lo:hi] = np.bincount(of, left / WINDOW, hi - lo)
                for j in range(c):
                    total[lo:hi, j] = np.bincount(of, p[:, j], hi - lo)
        known = has_letter(texts)
        z = total / np.sqrt(np.maximum(size, 1))[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def train(texts: pa.Array, langs: np.ndarray, seed: int = 5) -> ByteCnn:
    """Fit on windows of labelled texts by Adam steps over mini-batches, in numpy."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs.tolist()))
    y_text = np.array([names.index(x) for x in langs], np.int64)
    wins, ys = [], []
    for lo, hi, buf, off in text_chunks(texts):
        if len(buf):
            win, of, left = windows(buf, off)
            wins.append(win)
            ys.append(y_text[lo:hi][of])
    win, y = (np.concatenate(wins), np.concatenate(ys)) if wins else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64))
    take = [rng.permutation(np.flatnonzero(y == k))[:WINDOWS_PER_LANG] for k in range(len(names))]
    take = np.concatenate(take) if take else np.zeros(0, np.int64)
    win, y = win[take], y[take]
    # short texts: some windows are cut, so that the net also learns from few bytes
    for i in np.flatnonzero(rng.random(len(win)) < 0.25):
        win[i, rng.integers(8, WINDOW) :] = 0
    m = FILTERS * len(WIDTHS)
    mask = np.zeros((_TOP * DIM, m), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    net = ByteCnn(names, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.3, (_TOP * DIM, m)).astype(np.float32) * mask, np.zeros(m, np.float32), rng.normal(0, 0.1, (m, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return net
    params = ["embed", "conv", "conv_bias", "out", "out_bias"]
    m1 = {p: np.zeros_like(getattr(net, p)) for p in params}
    m2 = {p: np.zeros_like(getattr(net, p)) for p in params}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(win))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            x, n = win[part], len(part)
            cols = net._columns(x)
            y3 = (cols @ net.conv).reshape(n, _STEP, m)
            where = y3.argmax(axis=1)
            top = np.take_along_axis(y3, where[:, None, :], axis=1)[:, 0] + net.conv_bias
            act = np.maximum(top, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[part]] -= 1
            p /= n
            d_act = (p @ net.out.T) * (top > 0)
            # only the winning position of each filter has a gradient
            rows = np.arange(n)[:, None] * _STEP + where
            won = cols[rows.ravel()].reshape(n, m, _TOP * DIM)
            d_conv = np.einsum("nmk,nm->km", won, d_act) * mask
            d_won = (d_act[:, :, None] * net.conv.T[None]).reshape(n * m, _TOP, DIM)
            at = (where[:, :, None] + np.arange(_TOP)).reshape(n, -1)
            byte = np.take_along_axis(x, at, axis=1).reshape(-1)
            d_embed = np.stack([np.bincount(byte, d_won.reshape(-1, DIM)[:, j], 256) for j in range(DIM)], axis=1)
            grads = {"embed": d_embed, "conv": d_conv, "conv_bias": d_act.sum(0), "out": act.T @ p, "out_bias": p.sum(0)}
            t += 1
            for k in params:
                g = grads[k].astype(np.float32)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                setattr(net, k, (getattr(net, k) - RATE * (1 - epoch / EPOCHS) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> ByteCnn:
    """Train on a bounded number of texts of each language, outside the held-out fold (crc32 mod 3 = 1).

    Which texts is settled by a hash of the id, for all languages in one pass; within FIT_BYTES every
    language has its turn. Null languages and texts without letters take no part. All languages that the
    table names are learned.
    """
    known = docs.select(F.col("doc_id").alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).isNotNull().alias("_has"))
    known = known.where(F.col("_lang").isNotNull() & F.col("_has") & F.col("_id").isNotNull() & ~held_out("_id", 3, 1)).withColumn("_hash", F.xxhash64("_id", F.lit(11)))
    # first within SLOTS parts of a language, then among what these leave, which no table's size changes
    number = lambda *by: F.row_number().over(Window.partitionBy("_lang", *by).orderBy("_hash", "_id"))
    slots = known.withColumn("_slot", F.pmod("_hash", F.lit(SLOTS))).withColumn("_order", number("_slot")).where(F.col("_order") <= TEXTS_PER_LANG)
    picked = slots.withColumn("_order", number()).where(F.col("_order") <= TEXTS_PER_LANG).groupBy("_id", "_lang").agg(F.min("_order").alias("_order"))
    rows = docs.where(F.col(lang).isNotNull()).select("doc_id", F.col(text).alias("_t"), F.col(lang).cast("string").alias("_is"))
    got = bounded_texts(rows, picked, ["_lang"], text="_t", also="_is")
    texts, langs = got.column("text").combine_chunks(), np.array(got.column("_lang").to_pylist(), dtype=object)
    keep = has_letter(texts)
    return train(texts.filter(pa.array(keep)), langs[keep])


def identify(docs: DataFrame, net: ByteCnn, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with lang_pred and score; every row is kept.

    A null text, or one without a letter, gets UNKNOWN and 0. Columns of docs with the new
    columns' names are replaced. Nothing but the text is read for the prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.select(*[c for c in docs.columns if c not in (pred, score)])
    schema = extended(base, **{pred: T.StringType(), score: T.DoubleType()})

    def run(batches):
        m = shared.value
        for b in batches:
            got, s = m.predict(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns)], pa.array(got, pa.string()), pa.array(s, pa.float64())], names=[*b.schema.names, pred, score])

    return base.mapInArrow(run, schema)
