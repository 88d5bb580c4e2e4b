"""Word shingles as 64-bit hashes, computed over whole Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tracemill.llm.common import text_chunks

SHINGLE = 5
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_SHORT = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BACK)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                step = _U(pow(base, done, 2**64))
                with np.errstate(over="ignore"):
                    out[done : 2 * done] = out[: min(done, size - done)] * step
                done *= 2
            _powers[key] = out
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a text's border ends a word."""
    inside = _IN_WORD[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z folded, and the index of each text's first word (one more at the end)."""
    starts, ends = word_spans(buf, off)
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
        h = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, off)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than five words has its whole sequence as one shingle; a null text, or one
    without words, has the empty set.
    """
    out: list[np.ndarray] = []
    empty = np.zeros(0, dtype=np.uint64)
    for lo, hi, buf, off in text_chunks(texts):
        if not len(buf):
            out.extend([empty] * (hi - lo))
            continue
        w, at = word_hashes(buf, off)
        with np.errstate(over="ignore"):
            m = max(0, len(w) - SHINGLE + 1)
            full = np.zeros(m, dtype=np.uint64)
            for k in range(SHINGLE):
                full += w[k : k + m] * _PLACE[k]
            full = mix(full)
            for i in range(hi - lo):
                a, b = at[i], at[i + 1]
                if b - a >= SHINGLE:
                    s = np.sort(full[a : b - SHINGLE + 1])
                    keep = np.ones(len(s), dtype=bool)
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    out.append(s[keep])
                elif b > a:
                    out.append(mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _SHORT[b - a]))
                else:
                    out.append(empty)
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, the same for equal sets only (up to hash collisions)."""
    with np.errstate(over="ignore"):
        one = mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        two = mix(s * _U(0xE7037ED1A0B428DB) + _U(len(s))).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))
