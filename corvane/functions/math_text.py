"""Answers in LaTeX: extraction, two normal forms, and equivalence, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.algebra import algebraic_any

from corvane.functions import text as T
from corvane.sources.shared import written

#: What is replaced, and what is removed, in this order.
REPLACED = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Fixed values of the second form.
SHORTENED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
_FINAL = r"(?d)Final Answer: The final answer is(.*?). I hope it is correct\."


def _replace(v: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, v)


def boxed(v: Column) -> Column:
    """What stands in the braces of the last ``\\boxed`` or ``\\fbox``; null without one, or if they do not close."""
    return F.when(v.rlike(r"\\(boxed|fbox)"), T.once(F.regexp_extract(v, r"(?s)^.*\\(?:boxed|fbox)(.*)$", 1), lambda rest: _braced(v, rest)))


def _braced(v: Column, rest: Column) -> Column:
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        """A piece goes up to a brace."""
        now = s["open"] + piece.endswith("{").cast("int") - piece.endswith("}").cast("int")
        at, closes = s["at"] + F.length(piece), (s["end"] == 0) & piece.endswith("}") & (now == 0)
        return F.struct(now.alias("open"), at.alias("at"), F.when(closes, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, r"(?<=[{}])", -1), zero, step, lambda s: s["end"])
    inside = T.once(end, lambda end: F.when(end > 0, F.substring(rest, F.lit(2), end - 2)))
    simple = F.when(v.rlike(r"\\boxed ") & ~rest.startswith("{"), F.split(F.regexp_extract(v, r"(?s)^.*\\boxed (.*)$", 1), r"\$")[0])
    return F.coalesce(simple, F.when(rest.startswith("{"), inside))


def final_form(v: Column) -> Column:
    """Text after the last ``=``, without units, words and markup."""
    # Whatever is replaced has a letter or one of these marks.
    return T.once(F.substring_index(v, "=", -1), lambda v: F.when(v.rlike(r'[A-Za-z\\ $,"]'), _final(v)).otherwise(v))


def _final(v: Column) -> Column:
    v = _replace(_replace(v, REPLACED), [(x, "") for x in REMOVED])
    for pattern, new in ((r"(?d)(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(?d)(\\text\{)(.*?)(\})", "$2"), (r"(?d)(\\textbf\{)(.*?)(\})", "$2"), (r"(?d)(\\overline\{)(.*?)(\})", "$2"), (r"(?d)(\\boxed\{)(.*)(\})", "$2"), (r"(?d)(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}")):
        v = F.regexp_replace(v, pattern, new)
    v = F.translate(v, "$", "")
    return T.once(v, lambda v: F.when(F.translate(v, ",", "").rlike(r"^\d+$"), F.translate(v, ",", "")).otherwise(v))


def candidates(v: Column) -> Column:
    """The stated final answer and the boxed one; without either, what stands between the last two ``$``, or all."""
    stated = F.concat(v, F.lit("I hope it is correct."))
    stated = F.when(stated.rlike(_FINAL), final_form(T.strip(F.regexp_extract(stated, _FINAL, 1))))
    found = F.array_compact(F.array(stated, final_form(boxed(v))))
    parts = F.split(v, r"\$", -1)
    between = F.when(F.size(parts) > 2, final_form(F.element_at(parts, -2)))
    return T.once(found, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(between, final_form(v)))))


def short_form(v: Column) -> Column:
    """Without spaces, units and degrees; fractions and roots with braces; ``a/b`` as a fraction."""
    return T.once(v, lambda v: F.when(v.rlike(r"^\d+$") & ~v.endswith("\n"), v).otherwise(_short(v)))


def _short(v: Column) -> Column:
    steps = (_without_units, _leading_zeros, _right_side, _rooted, _fractions, _halves)
    return reduce(lambda x, step: T.once(x, step), steps, _replace(v, SHORTENED))


def _without_units(v: Column) -> Column:
    units = F.split(v, re.escape("\\text{ "), -1)
    return _replace(F.when(F.size(units) == 2, units[0]).otherwise(v), (("\\%", ""), (" .", " 0."), ("{.", "{0.")))


def _leading_zeros(v: Column) -> Column:
    return F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v)


def _right_side(v: Column) -> Column:
    sides = F.split(v, "=", -1)
    return F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), sides[1]).otherwise(v)


def _rooted(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"\\sqrt([^{])", r"\\sqrt{$1}"), " ", "")


def _fractions(v: Column) -> Column:
    subs = F.split(v, re.escape("\\frac"), -1)
    odd = F.exists(F.slice(subs, 2, F.size(subs)), lambda x: ~x.startswith("{") & (F.length(x) < 2))
    full = F.regexp_replace(F.regexp_replace(v, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    return F.when(odd, v).otherwise(full)


def _halves(v: Column) -> Column:
    plain = v.rlike(r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$")
    return F.when(v == "0.5", F.lit("\\frac{1}{2}")).when(plain, F.regexp_replace(v, "^(.*)/(.*)$", r"\\frac{$1}{$2}")).otherwise(v)


def equivalent(a: Column, b: Column, algebra: Callable[[Column, Column], Column] | None = None) -> Column:
    """Equal as they are or in the short form, or by ``algebra``, an optional expression for symbolic equality."""
    same = (a == b) | (short_form(a) == short_form(b))
    return same if algebra is None else same | F.coalesce(algebra(a, b), F.lit(False))


def solved(answer: Column, gold: Column) -> Column:
    """Whether some candidate is equivalent to the gold answer's form."""
    return solved_among(candidates(answer), gold)


def solved_among(found: Column, gold: Column, algebra: bool = False) -> Column:
    """The same of an array of candidates; with ``algebra`` one may also equal ``gold`` as a function.  The array is best a column of its own, as it is read twice then."""
    plain = T.once(gold, lambda gold: F.exists(found, lambda c: equivalent(c, gold)))
    return F.coalesce(plain, F.lit(False)) | algebraic_any(found, gold) if algebra else plain


def with_solved(rows: DataFrame, answer_col: str, gold_col: str, solved_col: str, algebra: bool = False) -> DataFrame:
    """``rows`` and whether their answer is solved, as :func:`solved_among` says of its candidates.

    Answers repeat: each different pair of an answer and a gold one is judged once, by all tasks of a shuffle, and written; then the pairs
    are joined to the rows, by broadcast if they are few.  Null answers and gold ones are values like others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.select(rows[answer_col].alias("pair_answer"), rows[gold_col].alias("pair_gold")).distinct().repartition(parts)
    found = pairs.withColumn("found", candidates(F.col("pair_answer")))
    judged = written(found.select("pair_answer", "pair_gold", solved_among(F.col("found"), F.col("pair_gold"), algebra).alias("pair_solved")), "solved")
    same = rows[answer_col].eqNullSafe(judged["pair_answer"]) & rows[gold_col].eqNullSafe(judged["pair_gold"])
    return rows.join(judged, same).select(*[rows[c] for c in rows.columns], F.col("pair_solved").alias(solved_col))
