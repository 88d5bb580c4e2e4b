"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm.common import held_out
from tracemill.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive against a replica with planted damage: one record in 89 altered, one in 97 lost."""
    from tracemill.llm import fixity

    pages = _table(spark, sf_dir, "pages")
    dice = F.coalesce(F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long"), F.lit(1))
    body = F.when(dice % 89 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("#"))).otherwise(F.col("html"))
    return fixity.audit(fixity.records(pages), fixity.records(pages, body, dice % 97 != 0))


OP2_SQL = r"""
with page as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
         coalesce(cast(cast(floor(page_id / 512.0) as bigint) as varchar), 'null') as f,
         coalesce(cast('0x' || substr(md5(cast(page_id as varchar)), 1, 6) as bigint), 1) as dice,
         chr(13) || chr(10) as eol
  from pages
),
rec as (
  select *, case when dice % 89 = 0 then html || '#' else html end as body,
         'WARC/1.0' || eol || 'WARC-Type: resource' || eol || 'WARC-Target-URI: ' || url || eol || 'Content-Length: ' as head
  from page
),
digested as (
  select page_id, f, url, dice,
         strlen(head || cast(strlen(html) as varchar) || eol || eol || html || eol || eol) as length,
         sha256(head || cast(strlen(html) as varchar) || eol || eol || html || eol || eol) as one,
         sha256(head || cast(strlen(body) as varchar) || eol || eol || body || eol || eol) as two
  from rec
),
laid as (
  select *, cast(coalesce(sum(length) over (partition by f order by page_id nulls first, url, one, two rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from digested
)
select 'part-' || f as file, cast(floor("offset" / 65536.0) as bigint) as "range", "offset",
       case when dice % 97 = 0 then 'missing_in_two' else 'changed' end as finding,
       one as digest_one, case when dice % 97 = 0 then null else two end as digest_two
from laid
where dice % 97 = 0 or one <> two
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import packing

    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import neural_lsh

    return neural_lsh.nearest(_table(spark, sf_dir, "embeddings"))


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, 0.3).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = os.environ.get("TRACEMILL_SP_MODEL", "/opt/tokenizers/piece_bpe_32k.model")) -> DataFrame:
    from tracemill.llm import sentencepiece_codec

    raw = sentencepiece_codec.read_model(spark, model_path)
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), raw)


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import bitsliced

    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"))


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import language

    docs = _table(spark, sf_dir, "documents")
    net = language.fit(docs.select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import license_scan

    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform("base", lambda d: d["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), labels("base").alias("base_labels"), labels("spans").alias("labels"), "score")


def op12_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import resampling

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, _table(spark, sf_dir, "benchmark"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """One document in ten repeats words of its own from some word on, by crc32 of its id; a null id repeats nothing."""
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluated once
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i).cast("int"))), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracemill.llm import periodic

    found = periodic.collapse(with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "b.start", (-F.col("b.l")).alias("length"), "b.period", F.expr("(-1000 * b.l) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP9_SQL = """
with q as (
  select vec_id, row_number() over () as rid, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
pairs as (
  select a.rid, a.vec_id as query_id, b.vec_id, cast(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) as bigint) as score
  from q a join q b on a.rid <> b.rid
  where a.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from pairs)
where rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if re.match(r"op\d+_", k)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": OP2_SQL, "op9_bit_sliced_top_k": OP9_SQL, "op11_license_rules": OP11_SQL, "op12_position_ngrams": OP12_SQL, "op13_periodic_runs": OP13_SQL}
