"""Equality of LaTeX expressions: shunting-yard into postfix, then values at points modulo large primes.

Two rational expressions that agree at random points modulo two primes of 61 bits are equal but for a chance under
10^-15 a pair. Where roots and the like come in, numbers are compared as numbers; with variables beside them nothing is decided.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, functions as F

_PRIMES = (2305843009213693951, 2305843009213693921)
_LONGEST = 2000
_TOKEN = re.compile(r"\s+|\d+\.?\d*|\.\d+|\\[a-zA-Z]+|\\.|.", re.DOTALL)
_SILENT = {"\\left", "\\right", "\\,", "\\;", "\\!", "\\ ", "\\displaystyle", "~"}
_SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "−": "-", "\\{": "{", "\\}": "}", "[": "(", "]": ")"}
_FUNCTIONS = {"\\sqrt": math.sqrt, "\\sin": math.sin, "\\cos": math.cos, "\\tan": math.tan, "\\ln": math.log, "\\log": math.log10, "\\exp": math.exp}
_POWER = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "^": 4}
_LETTERS = {"\\" + n for n in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau phi chi psi omega".split()}


class Undecided(Exception):
    """An expression outside the grammar, or a value that is not defined."""


def _tokens(text: str) -> list[str]:
    text = re.sub(r"\\[dt]?frac\s*(\d)", r"\\frac{\1}", text)  # a digit without braces is a group of its own
    text = re.sub(r"(\\frac\{[^{}]*\})\s*(\d)", r"\1{\2}", text)
    found = [_SIGNS.get(t, t) for t in _TOKEN.findall(text) if not t.isspace() and t not in _SILENT]
    out, i = [], 0

    def group(at: int) -> int:
        """The end of the braced group, or of the single token, that begins at `at`."""
        if at >= len(found):
            raise Undecided
        if found[at] != "{":
            return at + 1
        depth = 0
        for j in range(at, len(found)):
            depth += {"{": 1, "}": -1}.get(found[j], 0)
            if depth == 0:
                return j + 1
        raise Undecided

    closes: dict[int, list[str]] = {}
    while i < len(found):
        t = found[i]
        if t in ("\\frac", "\\dfrac", "\\tfrac"):  # two groups with a division between them, as one operand
            one = group(i + 1)
            two = group(one)
            out.append("(")
            closes.setdefault(one, []).insert(0, "/")
            closes.setdefault(two, []).insert(0, ")")
        elif t == "{":
            out.append("(")
        elif t == "}":
            out.append(")")
        else:
            out.append(t)
        i += 1
        out += closes.pop(i, [])
    return out


def postfix(text: str) -> list[tuple[str, object]]:
    """(kind, value) in postfix order; kinds are number, variable, constant, function and operator. Raises Undecided."""
    if len(text) > _LONGEST:
        raise Undecided
    out, waiting, operand = [], [], False

    def push(op: str) -> None:
        while waiting and waiting[-1] in _POWER and (_POWER[waiting[-1]] > _POWER[op] or _POWER[waiting[-1]] == _POWER[op] and op not in ("^", "neg")):
            out.append(("operator", waiting.pop()))
        waiting.append(op)

    for t in _tokens(text):
        opens = t == "(" or t in _FUNCTIONS
        value = ("number", Fraction(t)) if t[0].isdigit() or t[0] == "." and len(t) > 1 else ("constant", math.pi) if t in ("\\pi", "π") else ("variable", t) if t in _LETTERS or len(t) == 1 and t.isalpha() else None
        if (opens or value) and operand:
            push("*")  # side by side
            operand = False
        if value:
            out.append(value)
            operand = True
        elif opens:
            waiting.append(t)
        elif t == ")":
            if not operand:
                raise Undecided
            while waiting and waiting[-1] != "(":
                out.append(("operator", waiting.pop()) if waiting[-1] in _POWER else ("function", waiting.pop()))
            if not waiting:
                raise Undecided
            waiting.pop()
            if waiting and waiting[-1] in _FUNCTIONS:
                out.append(("function", waiting.pop()))
        elif t in "+-*/^" and len(t) == 1:
            if not operand:
                if t == "-":
                    waiting.append("neg")
                elif t != "+":
                    raise Undecided
                continue
            push(t)
            operand = False
        else:
            raise Undecided
    if not operand:
        raise Undecided
    while waiting:
        t = waiting.pop()
        if t == "(":
            raise Undecided
        out.append(("operator", t) if t in _POWER else ("function", t))
    return out


def _run(code, number, variable, constant, function, power):
    """The value of postfix code in an arithmetic of one's own; exponents are exact numbers beside it."""
    stack = []  # (value, exact rational or None)
    for kind, v in code:
        if kind == "number":
            stack.append((number(v), v))
        elif kind == "variable":
            stack.append((variable(v), None))
        elif kind == "constant":
            stack.append((constant(v), None))
        elif kind == "function":
            if not stack:
                raise Undecided
            stack.append((function(v, stack.pop()[0]), None))
        elif v == "neg":
            if not stack:
                raise Undecided
            a, ea = stack.pop()
            stack.append((-a, None if ea is None else -ea))
        else:
            if len(stack) < 2:
                raise Undecided
            (b, eb), (a, ea) = stack.pop(), stack.pop()
            both = ea is not None and eb is not None
            if v == "^":
                small = both and eb.denominator == 1 and abs(eb) <= 64 and (ea or eb > 0) and abs(ea.numerator) + ea.denominator < 1 << 32
                stack.append((power(a, b, eb), ea ** int(eb) if small else None))
            elif v == "/":
                stack.append((power(a, None, None, b), ea / eb if both and eb else None))
            else:
                op = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[v]
                exact = op(ea, eb) if both else None
                stack.append((op(a, b), exact if exact is not None and exact.denominator < 1 << 64 and abs(exact.numerator) < 1 << 64 else None))
    if len(stack) != 1:
        raise Undecided
    return stack[0][0]


def _modular(code, prime: int, seed: int) -> int:
    def no(*_):
        raise Undecided

    def power(a, b, exact, divisor=None):
        if divisor is not None:
            if divisor % prime == 0:
                raise Undecided
            return a * pow(divisor, -1, prime) % prime
        if exact is None or exact.denominator != 1 or exact < 0 and a % prime == 0:
            raise Undecided
        return pow(a, int(exact), prime)

    point = lambda name: int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest()) % prime
    return _run(code, lambda q: q.numerator * pow(q.denominator, -1, prime) % prime, point, no, no, power) % prime


def _real(code) -> float:
    def no(*_):
        raise Undecided

    def power(a, b, exact, divisor=None):
        out = a / divisor if divisor is not None else a**b
        if isinstance(out, complex):
            raise Undecided
        return out

    return float(_run(code, float, no, float, lambda f, x: _FUNCTIONS[f](x), power))


def _same(a, b) -> bool | None:
    """Whether two postfix codes mean the same; None if that is not decided."""
    plain = all(kind not in ("constant", "function") for kind, _ in a + b)
    fixed = all(kind != "variable" for kind, _ in a + b)
    if plain:
        try:
            if all(_modular(a, p, s) == _modular(b, p, s) for s, p in enumerate(_PRIMES * 2)):
                return True
            if not fixed:
                return False
        except Undecided:
            plain = False
    if not fixed:
        return None
    try:
        return math.isclose(_real(a), _real(b), rel_tol=1e-4)
    except (Undecided, ArithmeticError, ValueError):
        return None


def equal(a: str | None, b: str | None) -> bool | None:
    """Whether two expressions, or two equations, are equal; None where the grammar or the arithmetic does not reach.

    Two equations are equal if their sides' differences are, or differ in sign alone.
    """
    if a is None or b is None:
        return None
    try:
        if a.count("=") == 1 == b.count("="):
            (p, q), (r, s) = ([postfix(x) for x in e.split("=")] for e in (a, b))
            one, two, minus = [*p, *q, ("operator", "-")], [*r, *s, ("operator", "-")], [*s, *r, ("operator", "-")]
            return _same(one, two) or _same(one, minus)
        if "=" in a or "=" in b:
            return None
        return _same(postfix(a), postfix(b))
    except (Undecided, RecursionError, OverflowError):
        return None


def symbolic_equal(a, b) -> Column:
    """equal() of two columns, in Arrow batches; null where nothing is decided, or a side is null."""

    @F.pandas_udf("boolean")
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([equal(p if isinstance(p, str) else None, q if isinstance(q, str) else None) for p, q in zip(x, y)], dtype=object)

    return batch(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
