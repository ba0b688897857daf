"""Benchmark items: prompt messages, blanks, clean-up, choices and references, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

_MESSAGE = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def joined(a: Column, b: Column) -> Column:
    """Both stripped, with a space between if neither is empty."""
    return F.array_join(F.filter(F.array(T.strip(a), T.strip(b)), lambda x: x != ""), " ")


def prompt_messages(user: Column, shots: Column | None = None, system: str | None = None, multiturn: bool = True, description: str = "", final_description: str = "", assistant_prefix: str = "") -> Column:
    """Messages of a prompt; ``shots``: array<struct<user, assistant>>.

    Shots are turns of their own, or all in the one user message.  With shots, the assistant's
    prefix goes from the ends of user messages and opens the assistant's.
    """
    bare = lambda v: F.regexp_replace(v, r"(?U)\s*" + re.escape(assistant_prefix) + r"\s*$", "") if assistant_prefix else v
    asked = lambda v: F.concat(v, F.lit(final_description))
    head = F.array(_message("system", F.lit(system))) if system else F.array().cast(_MESSAGE)
    alone = F.array(_message("user", asked(F.concat(F.lit(description), user))))
    if shots is None:
        return F.concat(head, alone)
    if multiturn:
        turns = F.flatten(F.transform(shots, lambda s, i: F.array(_message("user", asked(bare(F.concat(F.when(i == 0, F.lit(description)).otherwise(F.lit("")), s["user"])))), _message("assistant", joined(F.lit(assistant_prefix), s["assistant"])))))
        with_shots = F.concat(turns, F.array(_message("user", asked(bare(user)))))
    else:
        told = F.concat(F.array_join(F.transform(shots, lambda s: F.concat(s["user"], s["assistant"])), "\n\n"), F.lit("\n\n"))
        with_shots = F.array(_message("user", asked(bare(F.concat(F.lit(description), told, user)))))
    return F.concat(head, F.when(F.size(shots) > 0, with_shots).otherwise(alone))


def blank_parts(sentence: Column) -> tuple[Column, Column]:
    """Text before and after the first ``_``."""
    at = F.instr(sentence, "_")
    return F.when(at > 0, F.substring(sentence, F.lit(1), at - 1)), F.when(at > 0, F.substring(sentence, at + 1, F.length(sentence)))


def without_brackets(v: Column) -> Column:
    """Titles become sentence ends, other bracketed parts go, and double spaces shrink once."""
    v = F.regexp_replace(F.regexp_replace(T.strip(v), r"\.? \[title\]", ". "), r"(?d)\[.*?\]", "")
    return F.replace(v, F.lit("  "), F.lit(" "))


def activity_query(label: Column, first: Column, second: Column) -> Column:
    return without_brackets(F.concat(label, F.lit(": "), first, F.lit(" "), T.capitalize(second)))


def choice_text(choice: Column) -> Column:
    """A choice without its letter."""
    return F.regexp_replace(choice, r"^\s*\([A-E]\)\s*|^\s*[A-E][.?]?\s*", "")


def spaced(v: Column) -> Column:
    """A space after a bracketed letter, and single line ends."""
    return F.regexp_replace(F.regexp_replace(v, r"(?U)(\([A-G]\))(\w)", "$1 $2"), "\n{2,}", "\n")


def exam_query(passage: Column, question: Column, options: Column) -> Column:
    letters = F.array(*map(F.lit, "ABCDEFGHIJ"))
    lines = F.transform(options, lambda o, i: F.concat(F.lit(" "), F.element_at(letters, i + 1), F.lit(". "), choice_text(o)))
    head = F.when(F.coalesce(passage, F.lit("")) != "", F.concat(passage, F.lit("\nQuestion: "))).otherwise(F.lit("Question: "))
    return spaced(F.concat(head, question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:")))


def gold_index(key: Column) -> Column:
    """Place of a letter or digit key, from 0."""
    return F.instr(F.lit("ABCDE"), F.translate(key, "12345", "ABCDE")) - 1


def merged_choices(first: Column, second: Column) -> tuple[Column, Column]:
    """(all choices, places of the second list's) of two target structs (choices, labels); the labels of shared ones must agree."""
    every = F.concat(first["choices"], F.filter(F.array_distinct(second["choices"]), lambda c: ~F.array_contains(first["choices"], c)))
    differ = F.exists(F.arrays_zip(second["choices"].alias("c"), second["labels"].alias("l")), lambda x: F.array_contains(first["choices"], x["c"]) & (F.get(first["labels"], F.array_position(first["choices"], x["c"]).cast("int") - 1) != x["l"]))
    places = F.transform(second["choices"], lambda c: (F.array_position(every, c) - 1).cast("int"))
    return every.alias("choices"), F.when(differ, F.raise_error(F.lit("labels of a shared choice differ"))).otherwise(places).alias("places")


def span_answers(spans: Column) -> Column:
    """References from spans that are texts; empty ones go."""
    return F.filter(spans, lambda a: a != "")


def list_span_answers(spans: Column) -> Column:
    """References from spans that are lists of texts, joined; empty ones go."""
    return F.filter(F.transform(spans, lambda s: F.array_join(s, " ")), lambda a: a != "")


def _float_text(v: Column) -> Column:
    """A number as decimal text with at least one place."""
    return v.try_cast("double").cast("string")


def open_normal(v: Column) -> Column:
    """Per token between spaces and hyphens: lower case, punctuation deleted unless it is a number, articles out, numbers as decimals."""

    def one(t: Column) -> Column:
        t = F.lower(t)
        number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
        t = F.regexp_replace(F.when(t.rlike(number), t).otherwise(T.without_punctuation(t)), T.ARTICLES, " ")
        return T.strip(F.regexp_replace(F.when(t.rlike(number), _float_text(T.strip(t))).otherwise(t), r"(?U)\s+", " "))

    return F.array_join(F.filter(F.transform(F.split(v, "[ -]", -1), one), lambda t: t != ""), " ")


def open_f1(pred: Column, gold: Column) -> Column:
    """F1 of the sets of normal tokens; 0 if either is empty."""
    a, b = (F.array_distinct(T.words(open_normal(v))) for v in (pred, gold))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(T.set_f1(a, b))


def best_open_scores(pred: Column, golds: Column) -> tuple[Column, Column]:
    """(em, f1): the best over the references that are not blank."""
    golds = F.filter(golds, lambda g: T.strip(g) != "")
    return T.best_of(lambda p, g: open_normal(p) == open_normal(g), pred, golds).alias("em"), T.best_of(open_f1, pred, golds).alias("f1")
