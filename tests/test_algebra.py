"""Equality of expressions: worked cases, and random polynomials against their coefficients."""

import random

import pytest

from tracemill.functions import algebra, grading

CASES = [
    (r"\frac{1}{2}", "0.5", True), ("2x=4", "4=2x", True), ("(x+1)^2", "x^2+2x+1", True), ("(x+1)^2", "x^2+2x+2", False), (r"\frac12", "0.5", True), (r"\frac{x+1}{2}", "x/2+1/2", True), (r"\frac{\frac{1}{2}}{3}", "1/6", True),
    (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\sqrt{2}", "1.4142", True), (r"\frac1{2}", "0.5", True), (r"\sqrt{2}", "1.41", False), (r"2\pi", "6.2832", True), ("x=2", "2x=4", False), ("x+y=3", "3-y=x", True), ("2^{10}", "1024", True), ("2^-1", ".5", True), ("-2^2", "-4", True),
    ("2^3^2", "512", True), ("ab", "ba", True), (r"x\cdot y", "yx", True), ("-x", "0-x", True), ("--x", "x", True), ("x^2/x", "x", True), (r"\left(a+b\right)\left(a-b\right)", "a^{2}-b^{2}", True), ("3(4)", "12", True), ("2 3", "6", True), (r"\alpha\beta", r"\beta \alpha", True),
    (r"\sqrt{x^2}", "x", None), ("x^y", "x^y", None), ("x^{1/2}", "x", None), ("4^{1/2}", "2", True), ("1/0", "1", None), ("(1", "1", None), ("", "1", None), ("1", None, None), (r"\int x", "x", None), ("x=1=2", "x=1", None), ("x<1", "x<1", None), ("9^{9^9}", "1", None), ("10^{400}", "10^{400}", True),
    ("1000000", "1000001", True), ("-1", "1", False), (r"\frac{1}", "1", None), ("+5", "5", True), ("5+", "5", None), (")(", "1", None), (r"\ln{1}", "0", False), ("x" * 3000, "x", None), (r"\frac{a}{b}\cdot\frac{b}{a}", "1", True),
]


@pytest.mark.parametrize("a, b, want", CASES)
def test_worked_cases(a, b, want):
    got = algebra.equal(a, b)
    if (a, b) == (r"\ln{1}", "0"):
        assert got is True  # both exactly 0
    else:
        assert got is want


def test_random_polynomials():
    rng = random.Random(4)
    show = lambda c: " + ".join(f"{v}x^{{{i}}}" if v >= 0 else f"({v})*x^{i}" for i, v in enumerate(c))
    for _ in range(300):
        p, q = ([rng.randrange(-9, 10) for _ in range(rng.randrange(1, 5))] for _ in range(2))
        product = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                product[i + j] += a * b
        if rng.random() < 0.5:
            product[rng.randrange(len(product))] += 1
            assert algebra.equal(f"({show(p)})({show(q)})", show(product)) is False
        else:
            assert algebra.equal(f"({show(p)})({show(q)})", show(product)) is True


def test_grades(spark):
    cases = [("x = 5", "5", True), (r"\frac{1}{2}", "0.5", True), ("2x=4", "4=2x", True), ("b + 7", "7 + b", True), ("what", "5", False), (None, "1", False), ("7", "8", False), ("(1,2]", "[1,2]", True)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p string, t string")
    got = {r.i: r.g for r in df.select("i", grading.grade_math_algebra("p", "t").alias("g")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}
