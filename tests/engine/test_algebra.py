"""Symbolic equality: a table of equal and unequal pairs."""

import pytest

from corvane.functions import math_text
from corvane.functions.algebra import algebraic, same_function

EQUAL = [
    (r"\frac{1}{2}", "0.5"), (r"\frac12", "2^{-1}"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}"), (r"\frac{6}{4}", r"\dfrac{3}{2}"), ("(x+1)^2", "x^2+2x+1"),
    ("x(y+z)", "xy + xz"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"2 \cdot 3 \pi", r"6\pi"), (r"\sqrt{2}\sqrt{3}", r"\sqrt{6}"), (r"\frac{1}{1+\sqrt{2}+\sqrt{3}}", r"\frac{2+\sqrt{2}-\sqrt{6}}{4}"), (r"-\left(a-b\right)", "b-a"),
    (r"\sqrt[3]{27}", "3"), ("4^{1/2}", "2"), ("-x^2", "-(x^2)"), ("6/2/3", "1"), (r"6\div 2\times 3", "9"), ("2^10", "1024"), (r"\sqrt{\frac{9}{4}}", "1.5"), ("2x^{2}y", "y x x 2"), ("1.", "1"), (r"\frac{a}{b}\cdot\frac{b}{a}", "1"), ("x^{-2}", r"\frac{1}{x^2}"), ("3 * -2", "-6"),
]
UNEQUAL = [
    (r"\frac{1}{2}", r"\frac{1}{3}"), (r"\sqrt{2}", r"-\sqrt{2}"), ("x+1", "x+2"), ("x^2", "2x"), (r"\sqrt{2}+\sqrt{3}", r"\sqrt{5}"), ("xy", "x+y"), (r"\pi", "3.14159"), ("a", "b"), ("1/0", "1/0"), ("", ""),
    ("x=1", "x=1"), (r"\sin x", r"\sin x"), (r"\sqrt{x^2}", "x"), (r"\sqrt{-4}", r"\sqrt{-4}"), ("(1,2)", "(1,2)"), ("2^{x}", "2^{x}"), ("(1+2", "3"), ("1+", "1"), ("9" * 100, "9" * 100), ("(" * 3000 + "1" + ")" * 3000, "1"), ("2^{1000}", "4^{500}"), (r"\frac{1}{x-x}", "1"),
]


@pytest.mark.parametrize("a, b", EQUAL)
def test_equal(a, b):
    assert same_function(a, b) and same_function(b, a)


@pytest.mark.parametrize("a, b", UNEQUAL)
def test_unequal(a, b):
    assert not same_function(a, b)


def test_through_spark(spark):
    pairs = [(a, b, True) for a, b in EQUAL] + [(a, b, False) for a, b in UNEQUAL] + [(None, "1", None), ("1", None, None)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", algebraic(df.a, df.b).alias("got")).collect())
    said = spark.createDataFrame([(r"so \boxed{\sqrt{12}}", r"2\sqrt{3}"), (r"so \boxed{\sqrt{12}}", r"3\sqrt{2}"), (r"\boxed{7}", "7"), (None, "1")], "answer string, gold string")
    assert [r.s for r in said.select(math_text.solved_among(math_text.candidates(said.answer), said.gold, algebra=True).alias("s")).collect()][:3] == [True, False, True]
    assert [r.s for r in said.select(math_text.solved(said.answer, said.gold).alias("s")).collect()][:3] == [False, False, True]
