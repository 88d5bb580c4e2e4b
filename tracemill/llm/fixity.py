"""Merkle fixity audit of WARC records: compare replicas by roots, descend where they differ.

Records are hashed where they lie; only digests move. A leaf is an ordered range of a file's
offsets, its hash is over the (offset, digest) pairs in it. A node covers FANOUT neighbouring ranges
of the level below, up to one root for each file. An audit compares roots, then only the children
of nodes that differ, then the records of ranges that differ, which locates the damage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.common import discard, materialise

#: Bytes of a leaf's offset range, children of a node.
RANGE_BYTES = 65_536
FANOUT = 16
#: Page ids whose records one WARC file holds, and records after which a file is cut.
FILE_PAGES, FILE_RECORDS = 512, 4096
#: Equal records that lie in a row.
RUN = 256


def record_bytes(url: Column, body: Column) -> Column:
    """A page as the bytes of a WARC record: header lines, a blank line, the body and two line ends."""
    block = F.coalesce(body.cast("binary"), F.lit(b""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame, body: Column | None = None, stored: Column | None = None) -> DataFrame:
    """(file, offset, length, digest, page_id): pages laid out as WARC files of FILE_PAGES page ids each.

    body is what the replica has on disk where that isn't html; offsets follow the archived length
    (of html), as damage in place moves nothing. stored tells whether the replica has the record.
    Within a file records are in the order of page_id, url and digests. A null page_id goes to a file
    of its own, null url and html are empty. Only digests and lengths are shuffled. Ids that repeat
    make a file longer: one of more than FILE_RECORDS records is cut into several by a hash of the
    record, and equal records, which are counted before they shuffle, are dealt to them in runs, so
    no id and no group of copies is one task's.
    """
    whole = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.octet_length(record_bytes(F.col("url"), F.col("html"))).cast("long").alias("length"),
        F.unhex(F.sha2(record_bytes(F.col("url"), F.col("html")), 256)).alias("archived"),
        F.unhex(F.sha2(record_bytes(F.col("url"), F.col("html") if body is None else body), 256)).alias("digest"),
        (F.lit(True) if stored is None else stored).alias("stored"),
    ).withColumn("file", F.concat(F.lit("part-"), F.coalesce(F.floor(F.col("page_id") / FILE_PAGES).cast("string"), F.lit("null"))))
    same = ["file", "page_id", "url", "length", "archived", "digest", "stored"]
    counted = whole.groupBy(*same).agg(F.count("*").alias("n"))
    full = counted.groupBy("file").agg(F.sum("n").alias("m")).where(F.col("m") > FILE_RECORDS).select("file", F.ceil(F.col("m") / FILE_RECORDS).cast("int").alias("cuts"))
    runs = counted.join(full, "file", "left").withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / RUN).cast("int") - 1)))
    runs = runs.withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN))
    # the replicas' files must agree, so the cut follows what was archived
    cut = F.pmod(F.xxhash64("page_id", "url", "archived", "run"), F.col("cuts"))
    runs = runs.withColumn("file", F.when(F.col("cuts").isNotNull(), F.concat_ws("-", "file", cut.cast("string"))).otherwise(F.col("file")))
    order = Window.partitionBy("file").orderBy("page_id", "url", "archived", "run", "digest", "stored").rowsBetween(Window.unboundedPreceding, -1)
    laid = runs.withColumn("first", F.coalesce(F.sum(F.col("length") * F.col("n")).over(order), F.lit(0)))
    each = laid.where("stored").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return each.select("file", (F.col("first") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", "page_id")


def leaves(recs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, node, hash, records): one row for each offset range that has a record.

    A range holds as many records as fit in its bytes, so the lists are bounded by the format; equal
    records at one place are counted first. A null digest is damage like any other and is hashed
    as "-".
    """
    counted = recs.groupBy("file", "offset", "digest").agg(F.count("*").alias("n"))
    entry = F.struct("offset", F.coalesce(F.hex("digest"), F.lit("-")).alias("digest"), "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda p: F.concat_ws(":", p["offset"].cast("string"), p["digest"], p["n"].cast("string"))), ",")
    return counted.groupBy("file", F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("n").alias("records"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: nodes of fanout neighbours each."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda p: F.concat(p["node"].cast("string"), F.lit(":"), p["hash"])), ",")
    return nodes.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("records").alias("records"))


def tree(recs: DataFrame, depth: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the files' roots (node 0)."""
    levels = [materialise(leaves(recs, range_bytes), "leaves")]
    for _ in range(depth):
        levels.append(materialise(parents(levels[-1], fanout), "nodes"))
    return levels


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) where the two levels differ, or only one has the node."""
    left = a.select("file", "node", F.col("hash").alias("x"))
    right = b.select("file", "node", F.col("hash").alias("y"))
    return left.join(right, ["file", "node"], "full").where("not (x <=> y)").select("file", "node")


def audit(one: DataFrame, two: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, range, offset, finding, digest_one, digest_two) of every record that differs.

    one and two have (file, offset, digest binary); finding is changed, or missing from the replica
    that lacks it: missing_in_one, missing_in_two. Two records at the same place of one replica are
    compared as a list, in order of digest; a null digest reads "-". Rows with a null file or offset
    lie nowhere and are left out. Equal replicas, and two empty ones, give an empty result.
    """
    sides = [materialise(r.where("file is not null and offset is not null").select("file", F.col("offset").cast("long").alias("offset"), "digest"), "records") for r in (one, two)]
    far = max((s.agg(F.max("offset")).first()[0] or 0) for s in sides)
    depth = max(1, math.ceil(math.log(far // range_bytes + 1, fanout) + 1e-9)) if far >= range_bytes else 1
    trees = [tree(s, depth, range_bytes, fanout) for s in sides]
    bad = _unlike(trees[0][-1], trees[1][-1])
    for level in range(depth - 1, -1, -1):
        below = []
        for t in trees:
            child = t[level].withColumn("up", F.floor(F.col("node") / fanout).cast("long"))
            below.append(child.join(bad.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi"))
        last, bad = bad, materialise(_unlike(*below), "unlike")
        discard(last)
    discard(*trees[0], *trees[1])
    found = []
    for s, name in zip(sides, ("digest_one", "digest_two")):
        near = s.withColumn("range", F.floor(F.col("offset") / range_bytes).cast("long")).join(bad.select("file", F.col("node").alias("range")), ["file", "range"], "left_semi")
        found.append(near.groupBy("file", "range", "offset").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce(F.lower(F.hex("digest")), F.lit("-")))), "+").alias(name)))
    both = found[0].join(found[1], ["file", "range", "offset"], "full").where("not (digest_one <=> digest_two)")
    finding = F.when(F.col("digest_one").isNull(), "missing_in_one").when(F.col("digest_two").isNull(), "missing_in_two").otherwise("changed")
    return both.select("file", "range", "offset", finding.alias("finding"), "digest_one", "digest_two")
