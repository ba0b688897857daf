"""Equality of LaTeX expressions as functions: exact values at rational points, in the rationals with square roots of whole numbers."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from functools import lru_cache
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points that must agree; largest exponent, digits of a number, and radicand to factor.
POINTS, EXPONENT, DIGITS, RADICAND = 3, 64, 60, 10**12

_TOKEN = re.compile(r"\s+|\\(?:left|right|,|;|!|:|quad|displaystyle)(?![a-zA-Z])|(\d+\.?\d*|\.\d+)|(\\[a-zA-Z]+)|([a-zA-Z])|([-+*/^(){}\[\]])")
_GREEK = {f"\\{x}" for x in "alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega".split()}


class Unknown(ValueError):
    """What is written is no expression that has a value here."""


#: A value: squarefree radicand -> coefficient; the empty one is zero.
Value = dict[int, Fraction]


def _sum(a: Value, b: Value, sign: int = 1) -> Value:
    out = dict(a)
    for d, c in b.items():
        out[d] = out.get(d, Fraction(0)) + sign * c
    return {d: c for d, c in out.items() if c}


def _product(a: Value, b: Value) -> Value:
    out: Value = {}
    for d, c in a.items():
        for e, f in b.items():
            g = gcd(d, e)
            out = _sum(out, {d * e // (g * g): c * f * g})
    return out


def _prime_of(a: Value) -> int | None:
    for d in a:
        if d > 1:
            return next((p for p in range(2, int(d**0.5) + 1) if d % p == 0), d)
    return None


def _inverse(a: Value) -> Value:
    """One over a value, made rational by conjugates, a prime's root at a time."""
    if not a:
        raise ZeroDivisionError
    p = _prime_of(a)
    if p is None:
        return {1: 1 / a[1]}
    conjugate = {d: -c if d % p == 0 else c for d, c in a.items()}
    return _product(conjugate, _inverse(_product(a, conjugate)))


def _power(a: Value, n: int) -> Value:
    if abs(n) > EXPONENT:
        raise Unknown("an exponent is too large")
    base, out = (_inverse(a) if n < 0 else a), {1: Fraction(1)}
    for _ in range(abs(n)):
        out = _product(out, base)
    return out


def _root(a: Value, degree: int) -> Value:
    """The root of a rational that is not negative: a square root, or a higher one that is whole."""
    x = a.get(1, Fraction(0))
    if set(a) - {1} or x < 0 or not 2 <= degree <= 9:
        raise Unknown("a root that is no square root of a rational")
    n, out, rest = x.numerator * x.denominator ** (degree - 1), 1, 1
    if n > RADICAND:
        raise Unknown("a radicand is too large")
    p = 2
    while p * p <= n:
        times = 0
        while n % p == 0:
            n, times = n // p, times + 1
        out, rest = out * p ** (times // degree), rest * p ** (times % degree)
        p += 1
    rest *= n
    if degree > 2 and rest > 1:
        raise Unknown("a higher root that is not whole")
    return {rest: Fraction(out, x.denominator)} if x else {}


class _Reader:
    """Reads an expression from left to right and returns its value at a point; variables have a value by name and point."""

    def __init__(self, text: str, point: int) -> None:
        self.point, self.at, self.tokens, place = point, 0, [], 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise Unknown(text[place])
            place = m.end()
            if m.lastindex:
                self.tokens.append(m.group(m.lastindex))

    def _now(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _take(self, token: str | None = None) -> str:
        now = self._now()
        if not now or token and now != token:
            raise Unknown(f"{now!r} where {token!r} is due")
        self.at += 1
        return now

    def whole(self) -> Value:
        out, _ = self._terms()
        if self._now():
            raise Unknown(self._now())
        return out

    def _terms(self) -> tuple[Value, bool]:
        out, constant = self._factors()
        while self._now() in ("+", "-"):
            sign = 1 if self._take() == "+" else -1
            value, fixed = self._factors()
            out, constant = _sum(out, value, sign), constant and fixed
        return out, constant

    def _factors(self) -> tuple[Value, bool]:
        out, constant = self._signed()
        while self._now() and self._now() not in ("+", "-", ")", "}", "]"):
            divide = False
            if self._now() in ("*", "/", "\\cdot", "\\times", "\\div"):
                divide = self._take() in ("/", "\\div")
            value, fixed = self._signed() if divide or self.tokens[self.at - 1] in ("*", "\\cdot", "\\times") else self._raised()
            out, constant = _product(out, _inverse(value) if divide else value), constant and fixed
        return out, constant

    def _signed(self) -> tuple[Value, bool]:
        if self._now() in ("+", "-"):
            sign = self._take()
            value, constant = self._signed()
            return (value if sign == "+" else _sum({}, value, -1)), constant
        return self._raised()

    def _raised(self) -> tuple[Value, bool]:
        base, constant = self._one()
        if self._now() != "^":
            return base, constant
        self._take()
        power, fixed = self._group() if self._now() == "{" else self._signed()
        n = power.get(1, Fraction(0))
        if set(power) - {1} or not fixed or n.denominator > 2 or n.denominator == 2 and not constant:
            raise Unknown("an exponent that is not whole")
        out = _power(base, n.numerator)
        return (_root(out, 2) if n.denominator == 2 else out), constant

    def _group(self) -> tuple[Value, bool]:
        close = {"(": ")", "{": "}", "[": "]"}[self._take()]
        out = self._terms()
        self._take(close)
        return out

    def _one(self) -> tuple[Value, bool]:
        now = self._now()
        if now in ("(", "{", "["):
            return self._group()
        self._take()
        if now[:1].isdigit() or now.startswith("."):
            if len(now) > DIGITS:
                raise Unknown("a number is too long")
            x = Fraction(now if not now.endswith(".") else now[:-1])
            return ({1: x} if x else {}), True
        if now in ("\\frac", "\\dfrac", "\\tfrac"):
            (above, a), (below, b) = self._argument(), self._argument()
            return _product(above, _inverse(below)), a and b
        if now == "\\sqrt":
            degree = 2
            if self._now() == "[":
                value, fixed = self._group()
                x = value.get(1, Fraction(0))
                if set(value) - {1} or not fixed or x.denominator != 1:
                    raise Unknown("a degree that is not whole")
                degree = int(x)
            inside, constant = self._argument()
            if not constant:
                raise Unknown("a root of a variable")
            return _root(inside, degree), True
        if len(now) == 1 and now.isalpha() or now in _GREEK:
            rng = random.Random(f"{now} {self.point}")
            return {1: Fraction(rng.randrange(1000, 10**6), rng.randrange(1000, 10**6))}, False
        raise Unknown(now)

    def _argument(self) -> tuple[Value, bool]:
        if self._now() == "{":
            return self._group()
        if re.fullmatch(r"\d{2,}", self._now()):  # \frac12: a digit each
            digits = self._take()
            self.at -= 1
            self.tokens[self.at : self.at + 1] = [digits[0], digits[1:]]
        return self._one()


@lru_cache(maxsize=100_000)
def same_function(a: str, b: str) -> bool:
    """Whether both are expressions of equal value at every point tried; points that divide by zero are passed over, up to as many again."""
    agreed = 0
    try:
        for point in range(2 * POINTS):
            try:
                if _Reader(a, point).whole() != _Reader(b, point).whole():
                    return False
                agreed += 1
            except ZeroDivisionError:
                continue
            if agreed == POINTS:
                return True
    except (Unknown, RecursionError):
        return False
    return False


def algebraic(a: Column, b: Column) -> Column:
    """Symbolic equality of two LaTeX expressions; false for what cannot be read, null for nulls.

    Sums, products, quotients, whole powers, fractions and roots of constants are known, of numbers, letters and Greek letters.
    """

    @F.pandas_udf("boolean")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else same_function(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return equal(a, b)


def algebraic_any(found: Column, gold: Column) -> Column:
    """Whether one of an array of expressions equals ``gold``; the same without a function inside a lambda."""

    @F.pandas_udf("boolean")
    def some(xs: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([q is not None and p is not None and any(x is not None and same_function(x, q) for x in p) for p, q in zip(xs, y, strict=True)], dtype=object)

    return some(found, gold)
