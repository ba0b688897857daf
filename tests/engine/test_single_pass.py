"""Predicates that find their words in one pass over the text: the same results as word by word, and no step a word in the plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.functions import text as T

TEXTS = [
    None, "", " \n", "And and, (and) or so... yet", "a b a b a", "one two three four", "Two three two Three", "-- !! --", "　x\x85y z\xa0", "STOP (NOW) Please! ÄÖ", "ab", "😀a😀a😀", "😀😀😀",
    "1 2 +3 x4 -5 6", "2 3 4", "p. s. more", "a *** b", "***", "don't re-do _x_ 'q'", "K and ſo", "\x1c a \x00b",
]


def bare(x: str) -> list[str]:
    return [w.strip(T.PUNCT) for w in words(x)]


def words(x: str) -> list[str]:
    return [w for w in "".join(" " if c in T.WHITE else c for c in x).split(" ") if w]


def plain(x: str) -> list[str]:
    return words("".join(c for c in x.lower() if c not in T.PUNCT))


CASES = [
    ("words:repeats", {"small_n": 2}, lambda x: max(Counter(plain(x)).values(), default=0) <= 2),
    ("words:no_consecutive", {}, lambda x: all(a[0] != b[0] for a, b in zip(plain(x), plain(x)[1:], strict=False))),
    ("count:unique_word_count", {"N": 3}, lambda x: len(set(bare(x.lower()))) >= 3),
    ("count:conjunctions", {"small_n": 3}, lambda x: len({w for w in words(x) if w.strip(T.PUNCT).lower() in C.CONJUNCTIONS}) >= 3),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, lambda x: sum(w.isupper() for w in bare(x)) >= 2),
    ("type:num_words", {"prev_response": "a b c"}, lambda x: len(plain(x)) == 3),
    ("ratio:overlap", {"reference_text": "😀a😀 two", "percentage": 50}, lambda x: (t := {x[i : i + 3] for i in range(len(x) - 2)}) and abs(100 * len(t & {"😀a😀", "a😀 ", "😀 t", " tw", "two"}) / len(t) - 50) <= 2),
    ("constraint:increment", {"small_n": 1, "prev_response": "1 2 3"}, lambda x: all(a + 1 == int(b) for a, b in zip((1, 2, 3), [w for w in words(x) if w.lstrip("+-").isdecimal()], strict=False))),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, lambda x: "p. s." in x),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, lambda x: sum(bool(p.strip()) for p in x.split("***")) == 2),
]


@pytest.mark.parametrize("name, given, want", CASES, ids=[x[0] for x in CASES])
def test_same_as_word_by_word(spark, name, given, want):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, v string")
    got = [r.got for r in df.select("i", C.strict(name, F.col("v"), given).alias("got")).orderBy("i").collect()]
    assert got == [bool(x and x.strip(T.WHITE) and want(x)) for x in TEXTS]


@pytest.mark.parametrize("name", ["words:repeats", "count:unique_word_count", "ratio:overlap", "words:no_consecutive", "type:num_words"])
def test_no_step_a_word(spark, name):
    given = {n: kw for n, kw, _ in CASES}[name]
    plan = spark.range(1).select(C.strict(name, F.col("id").cast("string"), given).alias("x"))._jdf.queryExecution().analyzed().toString().lower()
    assert not [x for x in ("array_sort(", "btrim(", "split(", "translate(") if x in plan.replace("ltrim(", "")]
