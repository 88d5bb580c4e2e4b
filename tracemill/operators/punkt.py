"""Sentence borders learned without labels: abbreviations, collocations and sentence starters by log-likelihood.

One pass over the texts counts neighbours: each token's type with its case, behind what kind of token it stands, and
behind which type where that ends in a period. All statistics come from that table, and decisions are taken once for each pair
of (type with a period, next type and case), not for each place; texts join the pairs that they hold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.text import let
from tracemill.sources.scratch import written

#: Thresholds of the published method: abbreviations, collocations, sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "#"


class Model(NamedTuple):
    """types: type, with_period, without, score, abbreviation, lower, upper_inside, after_border, starter; pairs: prev, type, both, collocation."""

    types: DataFrame
    pairs: DataFrame


def words(text) -> Column:
    """What white space parts."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token(word: Column) -> Column:
    """struct<type, ending, case> of a word, without brackets, quotes and marks around it.

    ending: "." for one period, "!" for ! and ?, "~" for an ellipsis, else "". case: U, L or "" by the first letter. The
    type is in lower case, without the ending; all numbers are one type.
    """

    def parts(bare: Column) -> Column:
        ending = F.when(F.endswith(bare, F.lit("..")) | F.endswith(bare, F.lit("…")), "~").when(F.endswith(bare, F.lit(".")), ".").when(F.endswith(bare, F.lit("!")) | F.endswith(bare, F.lit("?")), "!").otherwise("")
        body = F.lower(F.rtrim(bare, F.lit(".!?…")))
        kind = let(body, lambda t: F.when(t.rlike(r"^[-+]?[.,]?\d[\d.,-]*$"), NUMBER).otherwise(t))
        case = F.when(bare.rlike(r"^\p{Lu}"), "U").when(bare.rlike(r"^\p{Ll}"), "L").otherwise("")
        return F.struct(kind.alias("type"), ending.alias("ending"), case.alias("case"))

    return let(F.regexp_replace(word, r"""^[("'\[{]+|[)"'\]},;:]+$""", ""), parts)


def tokens(text) -> Column:
    """Array of the tokens of a text."""
    return F.transform(words(text), token)


def neighbour_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(behind, prev, type, ending, case, n): how often; behind is the ending before, "^" at a text's start, prev the type before where behind is a period.

    Words are counted as they are written first, each with the word before it where that may end a sentence, so only distinct
    ones are taken apart.
    """
    beside = lambda ws: F.transform(ws, lambda w, i: F.struct(F.when(i > 0, F.get(ws, i - 1)).alias("p"), w.alias("w")))
    one = docs.select(F.explode(let(words(text), beside)).alias("n")).select(F.col("n.p").isNull().alias("first"), F.when(F.col("n.p").rlike(r"[.!?…]"), F.col("n.p")).alias("p"), F.col("n.w").alias("w"))
    raw = one.groupBy("first", "p", "w").agg(F.count("*").alias("n")).select("first", token(F.col("p")).alias("p"), token(F.col("w")).alias("t"), "n")
    behind = F.when(F.col("first"), "^").otherwise(F.coalesce("p.ending", F.lit("")))
    return raw.groupBy(behind.alias("behind"), F.when(behind == ".", F.col("p.type")).alias("prev"), "t.type", "t.ending", "t.case").agg(F.sum("n").alias("n"))


def _x_log(x: Column, p: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(F.greatest(p, F.lit(1e-12))))


def period_score(with_period: Column, without: Column, periods: Column, total: Column, kind: Column) -> Column:
    """How well a type passes for an abbreviation: likelihood of its periods, lowered by its length and by its uses without one."""
    a, ab = with_period + without, with_period
    p, q = periods / total, F.lit(0.99)
    likelihood = -2 * (_x_log(ab, p) + _x_log(a - ab, 1 - p) - _x_log(ab, q) - _x_log(a - ab, 1 - q))
    dots = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = F.length(kind) - dots
    return likelihood * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(letters.cast("double"), -without.cast("double"))


def pair_likelihood(a: Column, b: Column, ab: Column, total: Column) -> Column:
    """Log-likelihood ratio that two events that occur a and b times, ab of them together, hang together."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, total))
    p, one, two = b / n, ab / a, F.when(n > a, (b - ab) / F.greatest(n - a, F.lit(1.0))).otherwise(1.0)
    free = _x_log(ab, p) + _x_log(a - ab, 1 - p) + _x_log(b - ab, p) + _x_log(n - a - b + ab, 1 - p)
    tied = F.when(a == ab, 0.0).otherwise(_x_log(ab, one) + _x_log(a - ab, 1 - one)) + F.when(b == ab, 0.0).otherwise(_x_log(b - ab, two) + _x_log(n - a - b + ab, 1 - two))
    return -2 * (free - tied)


def _initial(kind: Column) -> Column:
    return kind.rlike(r"^\p{L}$")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learn from all texts, in one pass; null and empty ones count nothing.

    What is learned is two tables, written in the shared folder: their sizes follow the vocabulary, and nothing of them is
    collected or broadcast by force.
    """
    counts = written(neighbour_counts(docs, text), "punkt-counts")
    m = F.sum("n")
    totals = counts.agg(F.coalesce(m, F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("ending") == ".", F.col("n"))), F.lit(0)).alias("periods")).first()
    total, periods = F.lit(float(totals.total)), F.lit(float(totals.periods))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    dotted = F.col("ending") == "."
    types = counts.groupBy("type").agg(some(dotted).alias("with_period"), some(~dotted).alias("without"))
    can = (F.col("with_period") > 0) & F.col("type").rlike(r"\p{L}") & (periods < total)
    score = F.when(can, period_score(F.col("with_period"), F.col("without"), periods, total, F.col("type"))).otherwise(0.0)
    types = written(types.withColumn("score", score).withColumn("abbreviation", F.col("score") >= ABBREVIATION), "punkt-types")
    # a border stands behind a mark, and behind a period whose type is no abbreviation
    known = counts.join(types.where("abbreviation").select(F.col("type").alias("prev"), F.lit(True).alias("_short")), "prev", "left")
    border = (F.col("behind") == "!") | ((F.col("behind") == ".") & F.col("_short").isNull() & (F.col("prev") != NUMBER) & ~_initial(F.col("prev")))
    start = border | (F.col("behind") == "^")
    seen = known.groupBy("type").agg(some(F.col("case") == "L").alias("lower"), some((F.col("case") == "U") & ~start & (F.col("behind") != "~")).alias("upper_inside"), some(border).alias("after_border"))
    borders = F.lit(float(known.agg(some(border)).first()[0]))
    all_ = F.col("with_period") + F.col("without")
    hold = (F.col("after_border") > 0) & F.col("type").rlike(r"^\p{L}+$") & (borders > 0)
    starter = hold & (pair_likelihood(borders, all_, F.col("after_border"), total) >= STARTER) & (total * F.col("after_border") > all_ * borders)
    learned = written(types.join(seen, "type").withColumn("starter", starter), "punkt-learned")
    # types that stand together across a period that numbers and initials end with
    across = known.where((F.col("behind") == ".") & (F.col("type").rlike(r"\p{L}") | (F.col("type") == NUMBER)) & ((F.col("prev") == NUMBER) | _initial(F.col("prev")) | F.col("_short")))
    together = across.groupBy("prev", "type").agg(m.alias("both"))
    size = types.select("type", (F.col("with_period") + F.col("without")).alias("_all"))
    sized = together.where("both > 1").join(size.withColumnsRenamed({"type": "prev", "_all": "_a"}), "prev").join(size.withColumnRenamed("_all", "_b"), "type")
    tied = (pair_likelihood(F.col("_a"), F.col("_b"), F.col("both"), total) >= COLLOCATION) & (total * F.col("both") > F.col("_a") * F.col("_b"))
    return Model(learned, written(sized.withColumn("collocation", tied).select("prev", "type", "both", "collocation"), "punkt-pairs"))


def decisions(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs (prev, ending, type, case) with border: whether a sentence ends between the two.

    A mark ends one. A period does unless the pair is a collocation; behind an abbreviation only before a capital whose type
    starts sentences, or is known in lower case and never capital inside; behind a number or an initial not before a small
    letter, and behind an initial not before a type that is never small. An ellipsis ends one as an abbreviation does.
    """
    prev = model.types.select(F.col("type").alias("prev"), F.col("abbreviation").alias("_short"))
    nxt = model.types.select("type", "lower", "upper_inside", "starter")
    ties = model.pairs.where("collocation").select("prev", "type", F.lit(True).alias("_tied"))
    df = pairs.join(prev, "prev", "left").join(nxt, "type", "left").join(ties, ["prev", "type"], "left")
    lower, inside, starter = F.coalesce("lower", F.lit(0)), F.coalesce("upper_inside", F.lit(0)), F.coalesce("starter", F.lit(False))
    fresh = (F.col("case") == "U") & (starter | ((lower > 0) & (inside == 0)))
    short, number, initial = F.coalesce("_short", F.lit(False)), F.col("prev") == NUMBER, _initial(F.col("prev"))
    border = (
        F.when(F.col("ending") == "!", True).when(F.coalesce("_tied", F.lit(False)), False).when((F.col("ending") == "~") | (short & ~initial), fresh)
        .when(number, F.col("case") != "L").when(initial, (F.col("case") != "L") & ~((F.col("case") == "U") & (lower == 0))).otherwise(True)
    )
    return df.select("prev", "ending", "type", "case", border.alias("border"))


def split(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with n_sentences and borders, the numbers of the tokens that end a sentence before the last.

    Rows are told apart by their place, so repeated rows stay. A null or blank text has no sentence, any other one more than it
    has borders. Columns of those names give way.
    """
    keep = [c for c in docs.columns if c != text and c not in ("n_sentences", "borders")]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_punkt"))
    here = lambda ts: F.transform(ts, lambda t, i: F.struct(t["type"].alias("prev"), t["ending"].alias("ending"), F.get(ts, i + 1)["type"].alias("type"), F.get(ts, i + 1)["case"].alias("case"), i.alias("at")))
    ends = lambda ts: F.struct(F.size(ts).alias("n"), F.filter(here(ts), lambda e: (e["ending"] != "") & e["type"].isNotNull()).alias("e"))
    doubt = rows.select("_row", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], let(tokens("_punkt"), ends).alias("_d"))
    held = written(doubt.select("*", F.col("_d.n").alias("_n"), F.col("_d.e").alias("_e")).drop("_d"), "punkt-ends")
    each = held.select("_row", F.explode("_e").alias("e")).select("_row", "e.*")
    told = decisions(each.select("prev", "ending", "type", "case").distinct(), model)
    found = each.join(told.where("border"), ["prev", "ending", "type", "case"]).groupBy("_row").agg(F.array_sort(F.collect_list("at")).alias("borders"))  # within a text
    out = held.drop("_e").join(found, "_row", "left").withColumn("borders", F.coalesce("borders", F.array().cast("array<int>")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.when(F.col("_n") > 0, F.size("borders") + 1).otherwise(0).cast("long").alias("n_sentences"), "borders")


def sentences(text, borders) -> Column:
    """The sentences of a text, its tokens joined by one space, from the borders that split gives."""
    t, b = F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+"), lambda w: w != ""), F.col(borders) if isinstance(borders, str) else borders
    whole = F.concat(F.array(F.lit(-1)), b, F.array(F.size(t) - 1))
    cut = F.transform(F.sequence(F.lit(1), F.size(whole) - 1), lambda i: F.array_join(F.slice(t, F.get(whole, i - 1) + 2, F.get(whole, i) - F.get(whole, i - 1)), " "))
    return F.when(F.size(t) > 0, cut).otherwise(F.array().cast("array<string>"))
