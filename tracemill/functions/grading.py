"""Grading predicates and reward arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracemill.functions.algebra import symbolic_equal
from tracemill.functions.text import clean_choice, let, parse_number, strip, vector_matrix


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def close(a, b, rel: float = 1e-4) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))


def grade_choice(pred, truth) -> Column:
    """1 if both are the same, or both missing."""
    return _c(pred).eqNullSafe(_c(truth)).cast("int")


def grade_connections(pred, truth) -> Column:
    """Number of predicted groups whose words are, as a set, a group of the truth; repeats count."""
    groups = lambda m: F.transform(F.map_values(m), lambda x: F.array_sort(F.array_distinct(x)))
    want = groups(_c(truth))
    return F.coalesce(F.size(F.filter(groups(_c(pred)), lambda g: F.array_contains(want, g))), F.lit(0)).cast("int")


def _plain_equal(p: Column, t: Column) -> Column:
    """Equal as text, as a choice, as a number (also as per cent), or but for brackets; two numbers are only compared as such."""

    def compare(v):
        a, b, x, y = v["a"], v["b"], v["x"], v["y"]
        choice = b.isin("A", "B", "C", "D", "E") & (v["c"] == b)
        number = close(x, y / 100) | close(x, y) | close(x, y * 100)
        loose = (a.startswith("[") & a.endswith("]") & ~b.startswith("(")) | (a.startswith("(") & a.endswith(")") & ~b.startswith("["))
        ends = lambda s: F.when(loose, F.regexp_replace(s, r"^[\[\]()]+|[\[\]()]+$", "")).otherwise(s)
        bare = lambda s: F.lower(F.translate(ends(s), "{}()", ""))
        return F.when((F.lower(a) == F.lower(b)) | choice, True).when(x.isNotNull() & y.isNotNull(), number).otherwise((a != "") & (bare(a) == bare(b)))

    return F.coalesce(let(F.struct(strip(p).alias("a"), strip(t).alias("b"), parse_number(p).alias("x"), parse_number(t).alias("y"), clean_choice(p).alias("c")), compare), F.lit(False))


def _all_equal(p: Column, t: Column) -> Column:
    """Two lists of equal length, part by part."""
    return (F.size(p) == F.size(t)) & F.forall(F.zip_with(p, t, _plain_equal), lambda ok: ok)


_MATRIX = r"(?s)^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$"


def _with_parts(p: Column, t: Column) -> Column:
    """Equal as they are, or as tuples or intervals part by part, or as matrices row by row."""
    parts = lambda s: F.split(F.substring(s, F.lit(2), F.length(s) - 2), ",")
    lines = lambda s: F.when(s.rlike(_MATRIX), F.filter(F.transform(F.split(F.regexp_extract(s, _MATRIX, 1), r"\\\\"), lambda r: strip(r)), lambda r: r != ""))

    def compare(v):
        a, b = v["a"], v["b"]
        bracketed = a.rlike(r"^[(\[].+[)\]]") & b.rlike(r"^[(\[].+[)\]]")
        rows = lambda m: (F.size(m["a"]) == F.size(m["b"])) & F.forall(F.zip_with(m["a"], m["b"], lambda x, y: F.coalesce(_all_equal(F.split(x, "&"), F.split(y, "&")), F.lit(False))), lambda ok: ok)
        matrices = F.when(a.rlike(_MATRIX) & b.rlike(_MATRIX), let(F.struct(lines(a).alias("a"), lines(b).alias("b")), rows))
        return _plain_equal(a, b) | F.when(bracketed, _all_equal(parts(a), parts(b))).otherwise(False) | F.coalesce(matrices, F.lit(False))

    truth = F.when(F.contains(p, F.lit("pmatrix")) & ~F.contains(t, F.lit("pmatrix")), vector_matrix(t)).otherwise(strip(t))
    return F.coalesce(let(F.struct(strip(p).alias("a"), truth.alias("b")), compare), F.lit(False))


def grade_math(pred, truth) -> Column:
    """Equal as text, choice or number, without brackets, part by part, row by row, or as what a short name equals.

    Parts are compared as they are, one level deep; an interval's kind of brackets does not count, so (1,2] equals [1,2]. Two
    sides of an equation, and anything else that needs algebra, are left to grade_math_algebra. A missing side is false.
    """
    p, t = _c(pred), _c(truth)
    sides = lambda s: F.split(s, "=")
    named = lambda s: (F.size(sides(s)) == 2) & (F.length(strip(sides(s)[0])) <= 2)
    value = lambda s, other: F.when(named(s) & ~F.contains(other, F.lit("=")), F.try_element_at(sides(s), F.lit(2)))
    one, two = value(p, t), value(t, p)
    return _with_parts(p, t) | F.when(one.isNotNull() | two.isNotNull(), _with_parts(F.coalesce(one, p), F.coalesce(two, t))).otherwise(False)


def grade_math_algebra(pred, truth) -> Column:
    """grade_math, or equal by algebra; only pairs that grade_math does not find equal are parsed. What is undecided is false."""
    p, t = _c(pred), _c(truth)
    plain = grade_math(p, t)
    return plain | F.coalesce(symbolic_equal(F.when(~plain, p), t), F.lit(False))


def grade_answer(dataset, pred, truth) -> Column:
    """Grade by the dataset's name: math 0 or 1, gpqa 0 or 1, connections the number of right groups; null for any other."""
    name, groups = F.lower(_c(dataset)), "map<string,array<string>>"
    puzzle = grade_connections(F.from_json(_c(pred), groups), F.from_json(_c(truth), groups))
    return F.when(name.contains("math"), grade_math_algebra(pred, truth).cast("int")).when(name.contains("gpqa"), grade_choice(pred, truth)).when(name.contains("connections"), puzzle)


def logit_score(logits, strategy: str = "auto") -> Column:
    """One score of an array of logits: single, class1, diff_last_first, or by their number."""
    x = _c(logits)
    first, second, last = F.try_element_at(x, F.lit(1)), F.try_element_at(x, F.lit(2)), F.try_element_at(x, F.lit(-1))
    if strategy == "single":
        return F.when(F.size(x) == 1, first)
    if strategy == "class1":
        return second
    if strategy == "diff_last_first":
        return F.when(F.size(x) >= 2, last - first)
    return F.when(F.size(x) == 1, first).when(F.size(x) == 2, second - first).otherwise(last)


def transform_score(score, kind: str = "identity") -> Column:
    s = _c(score)
    return {"identity": s, "sigmoid": 1 / (1 + F.exp(-s)), "tanh": F.tanh(s)}[kind]


def combine_rewards(rewards, mode: str) -> Column:
    """mean, min, max or first of a map of rewards; null for an empty one."""
    v = F.map_values(_c(rewards))
    total = F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    return {"mean": F.try_divide(total, F.size(v)), "min": F.array_min(v), "max": F.array_max(v), "first": F.try_element_at(v, F.lit(1))}[mode]
