"""One row of each group of near duplicates: what stays of a table, without a shuffle of its texts.

Rows are told apart by id where an id has one row. The ids that go are set in a bit map of bounded
size; rows that miss it stay where they lie. Hits of ids that stay are found on ids alone, and only
rows that a second map of these still can't settle are joined by id. Ids that several rows have, and
null ids, are settled row by row by the digest of the row's own set.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracemill.llm.common import materialise, own_name
from tracemill.llm.jaccard_join import _bloom, _slot
from tracemill.llm.shingles import set_key, shingle_sets


def _by_map(docs: DataFrame, ids: DataFrame, hit: bool) -> DataFrame:
    """Rows of docs whose doc_id may be in ids (column rep, distinct), or the rows that certainly are not."""
    whole, bits = _bloom(ids, ids.count())
    shared = docs.sparkSession.sparkContext.broadcast(whole)
    slot = own_name(docs, "_slot")

    def run(batches):
        m = shared.value
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            on = m[at >> 3] >> (at & 7).astype("uint8") & 1 == 1
            got = b.filter(pa.array(on if hit else ~on))
            yield pa.RecordBatch.from_arrays([got.column(i) for i in range(got.num_columns - 1)], names=got.schema.names[:-1])

    return docs.withColumn(slot, _slot(F.col("doc_id").cast("long"), bits)).mapInArrow(run, docs.schema)


def _with_sets(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the size and the digest of each row's set, under the given names."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = shingle_sets(part.column(at))
                keys = [set_key(s) for s in sets]
                more = ([len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns)], *[pa.array(m, pa.int64()) for m in more]], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, near: DataFrame) -> DataFrame:
    """docs less its near duplicates; near is what near_duplicates said of docs.

    Of each component the row stays whose doc_id is the component's. If several rows of that id are in
    the component, the one with the smallest set stays (by size, then digest), and of rows with one
    set the one with the smallest text, then the smallest row as JSON. Rows without words stay all.
    Rows with a null id go if their set is linked with a row that has one; else one row of each
    set stays. All columns are kept, whatever their names.
    """
    per = near.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("component_id") != F.col("doc_id")).alias("dup"))
    fate = F.when(F.col("doc_id").isNull() | (F.col("n") > 1), 2).when(F.col("dup"), 1)
    fates = materialise(per.select("doc_id", fate.alias("fate")).where("fate is not null"), "fates")
    known = docs.where("doc_id is not null")
    gone = fates.where("doc_id is not null").select(F.col("doc_id").alias("rep"))
    if not gone.limit(1).count():
        stays = known
    else:
        sure = _by_map(known, gone, False)
        # ids that stay though the map has them
        ids = _by_map(known.select(F.col("doc_id").cast("long").alias("doc_id")), gone, True).distinct()
        missed = materialise(ids.join(gone, ids["doc_id"] == gone["rep"], "left_anti").select(F.col("doc_id").alias("rep")), "missed")
        if missed.limit(1).count():
            doubt = _by_map(known, missed, True)
            sure = sure.unionByName(doubt.join(missed, doubt["doc_id"].cast("long") == missed["rep"], "left_semi"))
        stays = sure
    some = fates.where("fate = 2")
    if not some.limit(1).count():
        return stays
    # by row
    size, a, b = (own_name(docs, n) for n in ("_size", "_set_a", "_set_b"))
    several = some.where("doc_id is not null").select(F.col("doc_id").alias("rep"))
    rows = docs.where("doc_id is null")
    if several.limit(1).count():
        hits = _by_map(known, several, True)
        rows = rows.unionByName(hits.join(several, hits["doc_id"].cast("long") == several["rep"], "left_semi"))
    rows = materialise(_with_sets(rows, [size, a, b]), "several")
    told = near.join(some.select(F.col("doc_id").alias("_some")), F.col("doc_id").eqNullSafe(F.col("_some")), "left_semi").where("n_shingles > 0")
    heads = told.where("doc_id is not null and component_id = doc_id").groupBy("component", "doc_id").agg(F.min(F.struct("n_shingles", "set_a", "set_b")).alias("s"))
    loose = told.where("doc_id is null and component_id is null").select("doc_id", "set_a", "set_b").distinct()
    keep = heads.select("doc_id", "s.set_a", "s.set_b").unionByName(loose).select(F.col("doc_id").alias("_d"), F.col("set_a").alias("_a"), F.col("set_b").alias("_b"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.where(F.col(size) > 0).groupBy(F.col("doc_id").cast("long").alias("_d0"), F.col(a).alias("_a0"), F.col(b).alias("_b0")).agg(F.min_by(whole, F.struct(F.col("text"), F.to_json(whole))).alias("_row"))
    one = one.join(keep, F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_a0") == F.col("_a")) & (F.col("_b0") == F.col("_b")), "left_semi").select("_row.*")
    wordless = rows.where(F.col(size) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return stays.unionByName(one).unionByName(wordless)
