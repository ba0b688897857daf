"""Benchmark items as tables: choices and their scores, predictions, prompts, shots, seeded samples."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.scoring import accuracy, first_best

# ------------------------------------------------------------------ choices and scores


def choice_rows(docs: DataFrame, choices_col: str) -> DataFrame:
    """One row per document and choice: the document's columns but the list, choice_id from 0, choice."""
    rest = [c for c in docs.columns if c != choices_col]
    return docs.select(*rest, F.posexplode(choices_col).alias("choice_id", "choice"))


def gathered_scores(docs: DataFrame, scores: DataFrame, id_col: str, choices_col: str, score_col: str = "score") -> DataFrame:
    """``docs`` with ``scores``, the list of their choices' scores in choice order; a choice without a score counts 0, as does any of a document without one."""
    own = scores.select(F.col(id_col), F.struct("choice_id", F.col(score_col).cast("double").alias("score")).alias("one")).groupBy(id_col).agg(F.map_from_entries(F.collect_list("one")).alias("own"))
    listed = F.transform(F.sequence(F.lit(0), F.size(choices_col) - 1), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0.0)))
    return docs.join(own, id_col, "left").withColumn("scores", F.when(F.size(choices_col) > 0, listed).otherwise(F.array().cast("array<double>"))).drop("own")


def per_character(scores: Column, continuations: Column) -> Column:
    """Each score divided by its continuation's characters, the leading space counted."""
    return F.zip_with(scores, continuations, lambda s, c: s / F.length(c))


def choice_accuracies(rows: DataFrame, scores: Column, continuations: Column, gold: Column) -> DataFrame:
    """One row: acc by plain scores, acc_norm by scores per character, their counts, and total."""
    marked = rows.select((first_best(scores) == gold).alias("plain"), (first_best(per_character(scores, continuations)) == gold).alias("normal"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long")
    return marked.agg(F.coalesce(accuracy(F.col("plain")), F.lit(0.0)).alias("acc"), F.coalesce(accuracy(F.col("normal")), F.lit(0.0)).alias("acc_norm"), n("plain").alias("correct"), n("normal").alias("correct_norm"), F.count("*").alias("total"))


def gathered(logits: Column, ids: list[int]) -> Column:
    """The logits of some ids, such as the answer letters', in their order."""
    return F.array(*[F.element_at(logits, i + 1) for i in ids])


def continuation_score(logprobs: Column, mask: Column) -> Column:
    """Sum of the token log-probabilities under a 0/1 mask."""
    return F.aggregate(F.zip_with(logprobs, mask, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)


def left_cut(ids: Column, length: int) -> tuple[Column, Column]:
    """(the last ``length`` ids, place of the last one)."""
    n = F.least(F.size(ids), F.lit(length))
    return F.slice(ids, F.size(ids) - n + 1, n).alias("ids"), (n - 1).alias("last_idx")


def shifted_start(full: Column, context: Column, length: int) -> Column:
    """First target when context and continuation are cut on the left together: the context's end, less what was cut."""
    return F.greatest(F.size(context) - F.greatest(F.size(full) - length, F.lit(0)), F.lit(0)).alias("target_start")


# ------------------------------------------------------------------ prompts by task

#: Question and answer formats by task; ``{0}`` is the first column, ``{1}`` the second.
QUESTION = {
    "qa": "Question: {0}\nAnswer:",
    "bbh": "Q: {0}\nA: Let's think step by step.",
    "math": "Problem:\n{0}\n\nSolution:",
    "drop": "Passage: {0}\nQuestion: {1}\nAnswer:",
    "popqa": "Q: {0} A:",
    "truthfulqa": "Q: {0}\nA:",
}
BBH_OPENING = r"^Let's think step by step\."


def filled(template: str, *columns: Column) -> Column:
    """The template with its numbered places taken by the columns."""
    parts, rest = [], template
    for i, c in enumerate(columns):
        head, rest = rest.split(f"{{{i}}}", 1)
        parts += [F.lit(head), c]
    return F.concat(*parts, F.lit(rest))


def task_question(task: str, *columns: Column) -> Column:
    return filled(QUESTION[task], *columns)


def task_answer(answer: Column, task: str = "qa") -> Column:
    """A space and the answer; of step-by-step tasks without its opening, which the question holds."""
    return F.concat(F.lit(" "), F.regexp_replace(answer, BBH_OPENING, "") if task == "bbh" else answer)


def shots_prompt(question: Column, shots: list[tuple[str, str | list[str]]], k: int) -> Column:
    """The first k shots and the question, with blank lines between; several answers are joined by commas."""
    said = lambda a: a if isinstance(a, str) else ", ".join(a)
    head = "".join(f"Question: {q}\nAnswer: {said(a)}\n\n" for q, a in shots[:k])
    return F.concat(F.lit(head), task_question("qa", question))


def lettered(docs: DataFrame, question: Column, choices: Column, answer: Column) -> DataFrame:
    """Items of one form: question, choices_text, answer_idx, answer_text (its letter)."""
    letter = F.element_at(F.array(*map(F.lit, "ABCDEFGHIJ")), answer.cast("int") + 1)
    return docs.withColumns({"question": question, "choices_text": choices, "answer_idx": answer.cast("int"), "answer_text": letter})


def answered_shots(rows: DataFrame, golds: Column, order_col: str, k: int = 3) -> DataFrame:
    """The first k rows, by order, that have a gold answer."""
    return rows.filter(F.size(golds) > 0).orderBy(order_col).limit(k)


def other_shots(items: DataFrame, pool: DataFrame, group_col: str, order_col: str, text_col: str, max_pool: int = 10_000) -> DataFrame:
    """``items`` with ``shots``: the texts of all pool rows of other groups, in pool order; an item without a group takes none away.

    The pool is one small list that every item filters; a pool of more than ``max_pool`` rows raises.
    """
    own = pool.select(F.col(order_col).alias("o"), F.col(group_col).alias("g"), F.col(text_col).alias("t")).limit(max_pool + 1)
    listed = own.agg(F.sort_array(F.collect_list(F.struct("o", "g", "t"))).alias("pool"))
    listed = listed.withColumn("pool", F.when(F.size("pool") > max_pool, F.raise_error(F.lit(f"a pool of more than {max_pool} shots"))).otherwise(F.col("pool")))
    kept = F.filter("pool", lambda x: ~x["g"].eqNullSafe(F.col(group_col)))
    return items.join(F.broadcast(listed)).withColumn("shots", F.transform(kept, lambda x: x["t"])).drop("pool")


def references(*lists: Column) -> Column:
    """All references of the lists, each once."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


# ------------------------------------------------------------------ predictions


def predicted(requests: DataFrame, predictions: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Requests with their predictions' columns; a request without a prediction raises."""
    names = [c for c in predictions.columns if c != id_col]
    out = requests.join(predictions.withColumn("found", F.lit(True)), id_col, "left")
    checked = F.when(F.col("found"), F.col(id_col)).otherwise(F.raise_error(F.concat(F.lit("no prediction for "), F.col(id_col).cast("string"))))
    return out.withColumn(id_col, checked).select(*requests.columns, *names)


def scored_or_zero(requests: DataFrame, predictions: DataFrame, score: Column, golds: Column, id_col: str = "request_id") -> DataFrame:
    """Requests with ``score``; 0 without a prediction or without gold answers."""
    out = requests.join(predictions.withColumn("found", F.lit(True)), id_col, "left")
    return out.withColumn("score", F.when(F.col("found") & (F.size(golds) > 0), score).otherwise(F.lit(0.0))).select(*requests.columns, "score")


def strict_and_normal(rows: DataFrame, pred: Column, gold: Column, normal_match: Column) -> DataFrame:
    """One row: exact_match of normal forms, correct_strict of equal texts, total."""
    return rows.agg(F.coalesce(accuracy(normal_match), F.lit(0.0)).alias("exact_match"), F.coalesce(F.sum((pred == gold).cast("int")), F.lit(0)).cast("long").alias("correct_strict"), F.count("*").alias("total"))


def bbh_prediction(v: Column) -> Column:
    """What stands between the first ``the answer is `` and its line's last character, without full stops at its ends; empty without one."""
    found = T.first_match(v, r"(?d)(?<=the answer is )(.*)(?=.)", 1)
    return F.coalesce(F.regexp_replace(found, r"^\.+|\.+$", ""), F.lit(""))


# ------------------------------------------------------------------ samples and filters


def numbered(rows: DataFrame, order_col: str, block: int = 10_000) -> DataFrame:
    """``rows`` with ``pos``, their place by a whole-number order column, from 0: only counts of ranges are summed in order."""
    ranges = rows.groupBy(F.floor(F.col(order_col) / block).alias("range")).count()
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order_col))
    return rows.withColumn("range", F.floor(F.col(order_col) / block)).join(starts, "range").withColumn("pos", F.col("before") + own - 1).drop("range", "before")


def sample_places(n: int, k: int, seed: int) -> list[int]:
    """``random.Random(seed).sample(range(n), k)``, in its order."""
    return random.Random(seed).sample(range(n), k)


def sampled(rows: DataFrame, places: list[int], order_col: str) -> DataFrame:
    """The rows at these places, with ``ordinal``, their place in the list."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(places)), "ordinal long, pos long")
    return numbered(rows, order_col).join(F.broadcast(listed), "pos").drop("pos")


def held_out(rows: DataFrame, places: list[int], order_col: str) -> DataFrame:
    """The rows at other places."""
    listed = rows.sparkSession.createDataFrame([(x,) for x in places], "pos long")
    return numbered(rows, order_col).join(F.broadcast(listed), "pos", "left_anti").drop("pos")


def shuffled_sample(rows: DataFrame, n: int, k: int | None, order_col: str, seed: int = 42) -> DataFrame:
    """The first k rows of the dataset library's seeded shuffle, with ``ordinal``; all rows in their order if k is null or not less than n.

    The generator's permutation of n is drawn whole on the driver (8 bytes a row), k places of it are kept.
    """
    if k is None or k >= n:
        return numbered(rows, order_col).withColumnRenamed("pos", "ordinal")
    return sampled(rows, np.random.default_rng(seed).permutation(n)[:k].tolist(), order_col)


def of_categories(rows: DataFrame, category_col: str, allowed: list[str]) -> DataFrame:
    return rows.filter(F.col(category_col).isin(*allowed))
