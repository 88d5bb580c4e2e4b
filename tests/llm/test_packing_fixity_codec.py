import itertools
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import fixity, packing, sentencepiece_codec as codec


def padding(bounds, lengths, counts):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


def test_bucket_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        x = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        n = [rng.randrange(1, 50) for _ in x]
        k = rng.randrange(1, 5)
        got = packing.optimal_buckets(np.array(x), np.array(n), k)
        best = min(padding([*c, x[-1]], x, n) for m in range(min(k, len(x))) for c in itertools.combinations(x[:-1], m))
        assert len(got) <= k and got[-1] == x[-1] and got == sorted(got)
        assert padding(got, x, n) == best
    assert packing.optimal_buckets(np.array([]), np.array([]), 4) == []


def test_packing_keeps_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 30)
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90)))) for i in range(200)] + [(500, None), (501, " \n"), (7, "a b"), (7, "a b"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1)).repartition(5)
    got = packing.pack(packing.pieces(docs, 40), 40, 4, 200).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    batches = {}
    for r in got:
        assert r["length"] <= r["padded_length"] <= 40
        if r["length"] == 0:
            assert (r["bucket"], r["batch"], r["slot"]) == (-1, None, None)
        else:
            batches.setdefault((r["bucket"], r["batch"]), []).append((r["slot"], r["padded_length"]))
    for (bucket, batch), b in batches.items():
        size = b[0][1]
        assert len(b) * size <= 200 and sorted(s for s, _ in b) == list(range(len(b)))
        if (bucket, batch + 1) in batches:
            assert len(b) == 200 // size
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def plant(spark, n=400):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(n)] + [(5, None, None), (None, "u", "v"), (7, "http://h/7", "<p>7</p>" * 7)], "page_id long, url string, html string")


def test_audit_finds_just_the_damage(spark):
    pages = plant(spark)
    hurt, lost = [3, 77, 399], [78, 200]
    body = F.when(F.col("page_id").isin(hurt), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    there = F.coalesce(~F.col("page_id").isin(lost), F.lit(True))
    one, two = fixity.records(pages), fixity.records(pages, body, there)
    found = fixity.audit(one, two, range_bytes=512, fanout=4)
    at = {(r["file"], r["offset"]): r["page_id"] for r in one.collect()}
    got = sorted((at[r["file"], r["offset"]], r["finding"]) for r in found.collect())
    assert got == sorted([(i, "changed") for i in hurt] + [(i, "missing_in_two") for i in lost])
    assert fixity.audit(one, one).count() == 0 and fixity.audit(one.limit(0), two.limit(0)).count() == 0
    assert fixity.audit(two, one).where("finding = 'missing_in_one'").count() == len(lost)
    whole = [r["hash"] for r in fixity.tree(one, 3, 512, 4)[-1].orderBy("file").collect()]
    assert whole == [r["hash"] for r in fixity.tree(one.repartition(7), 3, 512, 4)[-1].orderBy("file").collect()]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def unigram_model(byte_fallback):
    """A unigram model file put together by hand; nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] * byte_fallback
    words = ["▁", "▁the", "▁c", "at", "cat", "▁cat", "s", "a", "t", "c", "h", "e", "th", "he", "▁▁", "é"]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


TEXTS = ["", "the cats", " the  cat", "thecat\tx", "été 日本 🎉", "cat" * 300, "a\nb", "q", "   ", "▁the ▁ cat▁", "\x00\ufffd", "the cats"]


@pytest.mark.parametrize("raw", [unigram_model(True), unigram_model(False), "/opt/tokenizers/piece_bpe_32k.model"], ids=["unigram bytes", "unigram", "bpe"])
def test_same_ids_as_the_sentencepiece_library(spark, raw):
    if isinstance(raw, str):
        raw = codec.read_model(spark, raw)
    assert all(codec.parity(raw, TEXTS))


def test_a_whole_table_by_unigram_scores(spark):
    """The pieces of the only model file at hand with made scores, as a unigram model: ids, decoder, parity on every text."""
    m = codec.parse_model(codec.read_model(spark, "/opt/tokenizers/piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    noise = rng.random(len(m.pieces))
    body = b"".join(message((1, message((1, p.encode()), (2, float(-np.log(7 + i) - 1 - noise[i]) if k == 1 else 0.0), (3, k)))) for i, (p, _, k) in enumerate(m.pieces))
    raw = body + message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    assert codec.parse_model(raw).kind == codec.UNIGRAM
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = codec.digests(docs, raw).collect()
    assert len(told) == 200 and all(r["round_trip"] for r in told)
    # the libraries break ties of equal scores ("&" "&&" or "&&" "&") in their own ways; all else is the same
    import sentencepiece

    ref, score = sentencepiece.SentencePieceProcessor(model_proto=raw), [s for _, s, _ in codec.parse_model(raw).pieces]
    unlike = {r["doc_id"] for r in told if not r["parity"]}
    assert len(unlike) <= 6
    for r in docs.collect():
        if r["doc_id"] in unlike:
            own, other = codec.encode(raw, [r["text"]])[0], ref.encode(r["text"])
            assert sorted(own) == sorted(other) and abs(sum(score[i] for i in own) - sum(score[i] for i in other)) < 1e-3


def test_round_trip(spark):
    raw = codec.read_model(spark, "/opt/tokenizers/piece_bpe_32k.model")
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(50, None, 2), (None, "x", 3), (51, "word " * 60_000, 4), (0, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    coded = codec.encode_documents(df, raw)
    back = codec.decode_documents(coded, raw).collect()
    assert len(back) == len(rows) and all(r["decoded"] == (r["text"] or "").replace("▁", " ") and r["n_ids"] == len(r["ids"]) for r in back)
    told = codec.digests(df, raw).collect()
    assert len(told) == len(rows) and all(r["parity"] for r in told)
    # a text that has the marker itself can't come back: the format writes spaces so
    assert {r["doc_id"] for r in told if not r["round_trip"]} == {i for i, t in enumerate(TEXTS) if "▁" in t}
    assert codec.digests(df.limit(0), raw).count() == 0


def test_a_wrong_decoder_breaks_the_round_trip(spark):
    # a decoder that gives texts back wrongly: the query must tell
    raw = codec.read_model(spark, "/opt/tokenizers/piece_bpe_32k.model")
    source = spark.createDataFrame([(1, "the cats"), (2, "")], "doc_id long, text string")

    class Wrong:
        def __init__(self, t):
            self.encode_batch_fast = t.encode_batch_fast

        def decode_batch(self, ids, skip_special_tokens):
            return ["x" if i else "" for i in ids]

    whole, got = codec._tokenizer(raw), []
    kept = codec._tokenizer
    codec._tokenizer = lambda _: Wrong(whole)
    try:
        # the function that the query hands to its workers, run here
        class Docs:
            sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda v: type("B", (), {"value": v}))})})

            def select(self, *_):
                return self

            def mapInArrow(self, run, schema):
                return list(run(source.toArrow().to_batches()))

        for b in codec.digests(Docs(), raw):
            got += zip(b.column("doc_id").to_pylist(), b.column("round_trip").to_pylist())
    finally:
        codec._tokenizer = kept
    assert got == [(1, False), (2, True)]


def test_words_are_counted_whole():
    assert packing.count_words(pa.array(["a b", None, "", " x\ty\n", "\x0b\x0c", "é"])).tolist() == [2, 0, 0, 2, 0, 1]


def test_batches_depend_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 200)
    monkeypatch.setattr(packing, "RUN", 50)
    rng = np.random.default_rng(3)
    rows = [(int(i), 0, 0, int(rng.integers(0, 300)), "x") for i in range(900)] + [(5, 0, 0, 77, "hot")] * 700 + [(None, 0, 0, 4, None)] * 3 + [(5, 0, 0, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, piece int, first_token long, length long, _part string").withColumn("batch", F.lit("old"))
    got = [sorted((tuple(r) for r in packing.pack(d, budget=4000).collect()), key=repr) for d in (df.repartition(3), df.repartition(8, "doc_id"), df.coalesce(1))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    seen = {}
    for *_, length, _, bucket, padded, batch, slot in got[0]:
        if length:
            assert length <= padded
            seen.setdefault((bucket, padded), []).append((batch, slot))
        else:
            assert (bucket, padded, batch, slot) == (-1, 0, None, None)
    for (_, padded), places in seen.items():
        room = max(1, 4000 // padded)
        assert sorted(places) == [(k // room, k % room) for k in range(len(places))]
    assert packing.pack(df.limit(0)).count() == 0 and packing.pieces(df.select("doc_id", F.lit(" ").alias("text")).limit(0)).count() == 0
    cut = packing.pieces(df.select("doc_id", "length", F.lit("a b").alias("text")).where("doc_id = 7"), 100, tokens="length").collect()
    assert sum(r["length"] for r in cut) == rows[7][3]


def test_null_digests_and_hot_pages(spark):
    cols = "file string, offset long, length long, digest binary, page_id long"
    one = spark.createDataFrame([("f", i * 100, 100, bytes([i]), i) for i in range(20)] + [("g", 0, 1, b"a", 1), ("g", 0, 1, b"a", 1)], cols)
    two = one.withColumn("digest", F.when(F.col("offset") != 500, F.col("digest")))
    assert sorted((r["offset"], r["digest_two"]) for r in fixity.audit(one, two).collect()) == [(500, "-")]
    less = one.where("file = 'f'").unionByName(spark.createDataFrame([("g", 0, 1, b"a", 1)], cols))
    assert [(r["digest_one"], r["digest_two"]) for r in fixity.audit(one, less).collect()] == [("61+61", "61")]
    # a third of all pages have one id, another third none: their files are cut, replicas alike
    hot = spark.range(15_000).select(F.when(F.col("id") % 3 == 0, 4).when(F.col("id") % 3 == 1, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    laid = fixity.records(hot)
    per = laid.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("places"), F.max(F.col("offset") + F.col("length")).alias("far"), F.sum("length").alias("bytes")).collect()
    assert sum(r["n"] for r in per) == 15_000 and max(r["n"] for r in per) < 2 * fixity.FILE_RECORDS
    assert all(r["n"] == r["places"] and r["far"] == r["bytes"] for r in per)
    assert fixity.audit(laid, fixity.records(hot.repartition(9))).count() == 0
    hurt = fixity.records(hot, F.when(F.col("html") == "16", "bad").otherwise(F.col("html")), F.lit(True))
    assert fixity.audit(laid, hurt).count() == hot.where("html = '16'").count()


@pytest.mark.parametrize("name", ["op2_warc_fixity", "op9_bit_sliced_top_k"])
def test_the_sql_twins(spark, name):
    import duckdb

    from tracemill.llm import queries

    con, path = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    twin = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in queries.queries()[name](spark, path).collect()))) == sorted(map(repr, twin.fetchall()))


def test_tasks_run_the_library_without_threads_of_its_own(spark, monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    raw = codec.read_model(spark, "/opt/tokenizers/piece_bpe_32k.model")
    seen, decode = [], codec.decode
    monkeypatch.setattr(codec, "decode", lambda *a: seen.append(os.environ.get("TOKENIZERS_PARALLELISM")) or decode(*a))

    # the function that the query hands to its workers, run here
    class Docs:
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda v: type("B", (), {"value": v}))})})

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})]))

    rows = pa.Table.from_batches(codec.digests(Docs(), raw)).to_pylist()
    assert seen == ["false"] and [r["n_ids"] > 0 for r in rows] == [True, False]
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")  # what a user sets stays
    codec.digests(Docs(), raw)
    assert seen == ["false", "true"]
