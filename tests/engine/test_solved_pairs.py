"""Answers that repeat: each different pair of an answer and a gold one is judged once, and every row gets its own."""

from collections import Counter

from pyspark.sql import functions as F

from corvane.functions import math_text
from corvane.plans.registry import QUERIES

PAIRS = [(r"so \boxed{\sqrt{12}}", r"2\sqrt{3}"), (r"so \boxed{\sqrt{12}}", r"3\sqrt{2}"), (r"\boxed{7}", "7"), (None, "1"), (r"\boxed{7}", None), (None, None), ("", ""), ("1", "1")]


def test_every_row_gets_its_own(spark):
    rows = spark.createDataFrame([(i, *PAIRS[i % len(PAIRS)]) for i in range(100)], "i int, answer string, gold string")
    want = rows.withColumn("found", math_text.candidates(F.col("answer"))).select("i", "answer", "gold", math_text.solved_among(F.col("found"), F.col("gold"), algebra=True).alias("s"))
    got = math_text.with_solved(rows, "answer", "gold", "s", algebra=True)
    assert got.columns == ["i", "answer", "gold", "s"]
    assert Counter(got.collect()) == Counter(want.collect())
    assert [r.s for r in got.orderBy("i").limit(4).collect()][:3] == [True, False, True]
    assert math_text.with_solved(rows.limit(0), "answer", "gold", "s").count() == 0


def test_rows_are_only_joined(spark):
    out = QUERIES["math_solved_by_algebra"](spark, "/root/testdata/sf0.001")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
