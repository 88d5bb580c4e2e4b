"""Token counts by a byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

#: Fixed value: how byte-level vocabularies of this kind part a text before merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the default vocabulary of ranks lies.
RANKS = os.environ.get("TRACEMILL_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _encoder(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(spark: SparkSession, path: str = RANKS) -> bytes:
    """A vocabulary's file of base64 tokens and ranks, by Spark's reader, so that it can lie where Spark's inputs do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def count_bpe_tokens(x, ranks: bytes, pattern: str = PATTERN) -> Column:
    """Number of tokens of a whole text; 0 for null and blank ones. Strings that look like special tokens are text.

    The vocabulary (a megabyte or so) goes with the function to each worker, which builds its encoder once.
    """

    @F.pandas_udf("long")
    def batch(texts: pd.Series) -> pd.Series:
        encoder = _encoder(ranks, pattern)
        return pd.Series([len(encoder.encode_ordinary(t)) if isinstance(t, str) and t.strip() else 0 for t in texts], dtype="int64")

    return batch(F.col(x) if isinstance(x, str) else x)
