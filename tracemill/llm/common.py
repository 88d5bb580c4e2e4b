"""What the operators share: scratch tables, text buffers, model broadcasts, block grids."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bound on the bytes of text that a fit reads.
FIT_BYTES = 96 << 20
#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 19


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder stands in, but only in local mode, as other
    hosts would not see it. What is not discarded before is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/tracemill-scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


#: Spark deletes a query's shuffle files when the query ends, not when the driver's memory is next cleaned.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to a scratch table, with folders for the columns of by, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path and _made.pop(path, None):
            _delete(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    """Scratch tables that results were still read from when the driver ended."""
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:  # a stopped session has no file systems to ask
            _delete(spark, path)


def extended(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """df's columns and further ones, as a schema of its own."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def own_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(column: str, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, equals fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about limit bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    large = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def per_text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets, 0 for an empty run."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def bounded_texts(docs: DataFrame, picked: DataFrame, columns: list[str], budget: int = FIT_BYTES, text: str = "text", also: str | None = None) -> pa.Table:
    """(columns, text) of the picked rows, for fitting: one text for each row of picked, in its order.

    picked has _id, columns and _order, one row for each id and columns, and is of bounded number; also
    names a column of docs that must equal the first of columns. Where rows of docs repeat an id, the
    least of their texts stands for it, aggregated before it shuffles; null texts take no part. In ascending _order texts are taken whole until budget bytes are full; a text
    that does not fit is passed over.
    """
    # picked is bounded by its documented number of rows, so its broadcast is
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col(text).cast("string").alias("_text"), F.col(also or "doc_id").alias("_also")).where("_text is not null")
    joined = rows.join(F.broadcast(picked), (F.col("_doc") == F.col("_id")) & (F.col("_also") == F.col(columns[0]) if also else F.lit(True)))
    held = materialise(joined.groupBy("_id", "_order", *columns).agg(F.min("_text").alias("_text")), "fit")
    sizes = held.select("_id", "_order", *columns, F.octet_length("_text").alias("_n")).toPandas().sort_values(["_order", "_id", *columns])
    left, keep = budget, []
    for k, n in zip(sizes.index, sizes["_n"]):
        if n <= left:
            left -= n
            keep.append(k)
    chosen = sizes.loc[keep]
    out = pa.table({**{c: pa.array([], pa.string()) for c in columns}, "text": pa.array([], pa.string())})
    if len(chosen):
        rows = held.select("_id", "_order", *columns, F.col("_text").alias("text"))
        few = docs.sparkSession.createDataFrame(chosen[["_id", *columns]])
        out = rows.join(F.broadcast(few), ["_id", *columns], "left_semi").toArrow().sort_by([("_order", "ascending"), ("_id", "ascending")]).select([*columns, "text"])
    discard(held)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7):
    """A bounded training sample: at most per_class texts of each label, folds 1 to 4 of crc32 mod 5 only.

    Returns (texts, label array). The bounds (per_class, FIT_BYTES) hold for fitting alone; every text is
    scored. Rows that repeat an id are one text; rows with a null id, text or label take no part, and
    an id that is labelled both ways counts once for each.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    known = known.where(F.col("_id").isNotNull() & ~held_out("_id", 5, 0)).distinct().withColumn("_order", F.xxhash64(F.col("_id"), F.lit(seed)))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy("_order", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = bounded_texts(docs, picked, ["_y"])
    return rows.column("text").combine_chunks(), np.asarray(rows.column("_y").to_pylist(), np.int64)
