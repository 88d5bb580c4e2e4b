"""Token counts against another library with the same vocabulary."""

import os

import pytest

from tracemill.functions import tokens

OTHER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not (os.path.exists(OTHER) and os.path.exists(tokens.RANKS)), reason="no vocabulary here")
def test_counts_equal_those_of_another_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(OTHER)
    other.encode_special_tokens = True
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "<|endoftext|> x"), (-5, "don't  stop\n\n 123 ñ 𝄞"), (-6, "word " * 20000)]
    df = spark.createDataFrame(docs + odd, "i long, t string")
    got = {r.i: r.n for r in df.select("i", tokens.count_bpe_tokens("t", tokens.read_ranks(spark)).alias("n")).collect()}
    want = {i: len(other.encode(t, add_special_tokens=False).ids) if t and t.strip() else 0 for i, t in docs + odd}
    assert got == want
