"""Importance resampling towards a target corpus, over hashed n-grams from a table of word positions.

posexplode lays out each document's words with their positions, window lead() joins each word to those that
follow it, and every n-gram's hash names a bucket. Buckets are counted over both corpora, and each
document's mean log ratio, with Gumbel noise that hangs on its id alone, is its place in the draw.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.common import discard, materialise, own_name

#: Words, before A-Z are lowered: no other ASCII characters than letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z as a-z and nothing else changed; lower() does so where all is ASCII, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def positions(docs: DataFrame, keep: list[str], text: str = "text", orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """(_row, keep, b1 .. b<orders>): for each word of each row the buckets of the n-grams that begin there.

    A bucket is null where the n-gram would pass the text's end; a row without words has one row of nulls.
    Texts are dealt by row before they are laid out, so the window needs no further exchange.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_grams_text"))
    words = F.regexp_extract_all(F.coalesce("_grams_text", F.lit("")), F.lit(WORD), F.lit(0))
    laid = rows.repartition("_row").select("_row", *[F.col(f"`{c}`") for c in keep], F.posexplode_outer(words).alias("_pos", "_word")).withColumn("_word", lower_ascii(F.col("_word")))
    w = Window.partitionBy("_row").orderBy("_pos")
    grown = laid.select("*", *[F.lead("_word", k).over(w).alias(f"_next{k}") for k in range(1, orders)])
    gram, out = F.col("_word"), []
    for k in range(1, orders + 1):
        out.append((F.crc32(gram) % buckets).cast("int").alias(f"b{k}"))
        gram = F.concat(gram, F.lit(" "), F.col(f"_next{k}")) if k < orders else gram
    return grown.select("_row", *[F.col(f"`{c}`") for c in keep], *out)


def counts(grams: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs."""
    each = grams.select(F.explode(F.array(*[F.col(f"b{k}") for k in range(1, orders + 1)])).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the log ratio of smoothed shares, floored."""
    spark = source.sparkSession
    held = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts(source, orders, "s"), "bucket", "left").join(counts(target, orders, "t"), "bucket", "left")
    held = materialise(held.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]), "bucket-counts")
    s, t = held.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(s + buckets) / ((F.col("s") + 1) * F.lit(t + buckets))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, floored, by sha256 of seed:key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, orders: int = 2, buckets: int = 10_000, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """docs without the text, with n_features, weight, score and rank: rank 1 to the number drawn, null for the rest.

    Of the rows with least_words words or more, percent in a hundred are drawn, floored: those of highest score, ties
    by smaller key (null last), then by more features, then by the row's place in the input. weight is the floored mean of the gains of a
    row's n-grams, 0 where it has none; score adds the noise of its key, a null key counting as empty.
    Each row stands for itself, also where keys or whole rows repeat; null and empty texts have no features
    and are never drawn; empty corpora count nothing; texts are read whole. Columns named like the new
    ones give way. Ranks come from a sort by ranges: no task sees more than its range.
    """
    made = ["n_features", "weight", "score", "rank"]
    keep = [c for c in docs.columns if c != text and c.lower() not in made]
    inner = [f"c{k}" for k in range(len(keep))]  # apart from the names of this operator
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], F.col(f"`{text}`").alias("_text"))
    aside = [i for c, i in zip(keep, inner) if c != key]
    k = inner[keep.index(key)]
    grams = materialise(positions(given, inner, "_text", orders, buckets), "grams")
    goal = positions(target.select(F.col(f"`{target_text}`").alias("_text")), [], "_text", orders, buckets)
    table = gains(grams, goal, orders, buckets)
    found = grams
    for o in range(1, orders + 1):  # a row for each of the given number of buckets, whatever the corpora
        found = found.join(F.broadcast(table.select(F.col("bucket").alias(f"b{o}"), F.col("gain").alias(f"g{o}"))), f"b{o}", "left")
    total = sum((F.coalesce(F.col(f"g{o}"), F.lit(0)) for o in range(2, orders + 1)), F.coalesce("g1", F.lit(0)))
    n = sum((F.count(f"b{o}") for o in range(2, orders + 1)), F.count("b1"))
    each = found.groupBy("_row", k, *aside).agg(n.alias("n_features"), F.count("b1").alias("_words"), F.sum(total).alias("_sum"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = each.withColumn("weight", weight).withColumn("score", (F.col("weight") + noise(F.col(k), seed)).cast("long")).drop("_sum")
    can = F.col("_words") >= least_words
    order = [F.col("score").desc(), F.col(k).asc_nulls_last(), F.col("n_features").desc(), F.col("_row")]
    # one write: those that can be drawn in ranges of the order, numbered within each; the others behind them
    place = F.monotonically_increasing_id()
    laid = materialise(scored.withColumn("_can", can).orderBy(F.col("_can").desc(), *order).withColumn("_at", place), "draw")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("m"), F.count_if("_can").alias("n")).orderBy("_part").collect()  # a row for each range
    begins, at = [], 0
    for p, m, _ in sizes:
        begins.append((p, at))
        at += m
    limit = percent * sum(r.n for r in sizes) // 100
    starts = laid.sparkSession.createDataFrame(begins or [(0, 0)], "_part long, _begin long")
    spot = F.col("_begin") + within + 1
    out = laid.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part", "left").withColumn("rank", F.when(F.col("_can") & (spot <= limit), spot).cast("long"))
    discard(grams)
    return out.select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")
