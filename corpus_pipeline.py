"""The corpus pipeline: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the
last return the columns of documents. `run` writes each stage's rows as Parquet in the shared
scratch folder and reads them back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm import jaccard_join, language, packing, pii, quality, survivors
from tracemill.llm.common import discard, materialise, own_name

#: Documents below this quality score go.
QUALITY = 0.3
#: Documents whose language is known with less than this go, as do those without a letter.
LANGUAGE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are judged by the prior, repeated rows alike, long texts whole. Columns of
    any name pass through; an empty table gives an empty one.
    """
    score, kept = own_name(docs, "_score"), own_name(docs, "_kept")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model, QUALITY, score=score, predicted=kept).where(F.col(kept) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; texts that are null or have no letter go.

    Repeated rows are judged alike, long texts whole. Columns of any name pass through; an empty
    table gives an empty one.
    """
    pred, score = own_name(docs, "_pred"), own_name(docs, "_score")
    told = language.identify(docs, language.fit(docs), pred=pred, score=score)
    return told.where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LANGUAGE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Texts without words are nobody's duplicates and stay. Rows that repeat an id are told apart by
    their sets of shingles: a text that no other row is near stays whatever its id, and of equal
    rows one stays. Rows with a null id go if a row with an id is near, else one of each set
    stays. See survivors.one_of_each for the choice among equals.
    """
    return survivors.one_of_each(docs, jaccard_join.near_duplicates(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind; n_chars follows the new text.

    Null and empty texts stay as they are, repeated rows stay and are masked alike, long texts whole. Columns of
    any name pass through; an empty table gives an empty one.
    """
    return pii.redact(docs, pii.fit(docs))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, first_token, length, bucket, padded_length, batch, slot) of every piece of every document.

    A null or empty text is a piece of length 0 in no batch; repeated rows each have their pieces.
    """
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_batches),
]

#: Learned models decide three of the stages, so no SQL gives the same rows. Tests hold the near-duplicate and
#: packing stages against brute force, the classifiers' stages against their models text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
