"""Scores: choice by likelihood, per-group and overall means, cross entropy, norms, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_best(scores: Column, n_options: Column | None = None) -> Column:
    """Index of the greatest score, the first of equals; only the first n_options count if given."""
    scores = scores if n_options is None else F.slice(scores, F.lit(1), n_options)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def accuracy(correct: Column) -> Column:
    """Share of true values; 0 without rows."""
    return F.sum(correct.cast("int")) / F.greatest(F.count("*"), F.lit(1))


def grouped_accuracy(rows: DataFrame, group_col: str, correct_col: str) -> tuple[DataFrame, DataFrame]:
    """(accuracy by group, one row of macro_acc and micro_acc), the second from the first."""
    c = F.col(correct_col).cast("int")
    groups = rows.groupBy(group_col).agg(F.count("*").alias("n"), F.sum(c).alias("n_correct"), F.avg(c).alias("acc"))
    total = groups.agg(F.avg("acc").alias("macro_acc"), (F.sum("n_correct") / F.greatest(F.sum("n"), F.lit(1))).alias("micro_acc"), F.sum("n").alias("n"), F.sum(F.bround(F.col("acc") * F.col("n"))).cast("long").alias("n_correct_rederived"))
    return groups, total


def true_mass(logprobs: Column, true_idx: Column) -> tuple[Column, Column]:
    """(mc1, mc2): whether the first greatest is true, and the true choices' share of probability; no shift by the maximum."""
    p = F.transform(logprobs, lambda x: F.exp(x))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    total, true = add(p), add(F.transform(true_idx, lambda i: F.element_at(p, i.cast("int") + 1)))
    return F.array_contains(true_idx, first_best(logprobs)).alias("mc1"), F.when(total > 0, true / total).otherwise(0.0).alias("mc2")


def leading_mass(logprobs: Column, n_true: Column) -> Column:
    """Share of the first n_true choices under a softmax."""
    top = F.array_max(logprobs)
    p = F.transform(logprobs, lambda x: F.exp(x - top))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return add(F.slice(p, F.lit(1), n_true)) / add(p)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(logits, lambda x: x - top - F.log(total))


def cross_entropy(logprob: Column, mask: Column) -> list[Column]:
    """Aggregates of token log-probabilities: ce_sum, n_tokens, ce_mean, perplexity (of at most e**20)."""
    total, n = F.sum(-logprob * mask), F.sum(mask)
    mean = total / F.greatest(n, F.lit(1))
    return [total.alias("ce_sum"), n.alias("n_tokens"), mean.alias("ce_mean"), F.exp(F.least(mean, F.lit(20.0))).alias("perplexity")]


def z_loss(logits: Column, target: Column, weight: float = 1e-5) -> Column:
    """Cross entropy of the target plus weight * logsumexp ** 2."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return lse - F.element_at(logits, target + 1) + weight * lse * lse


def norms(values: DataFrame, leaf_col: str, value_col: str) -> DataFrame:
    """L2 norm of each leaf and, with a null leaf, of all."""
    x = F.col(value_col).cast("double")
    return values.rollup(leaf_col).agg(F.sqrt(F.sum(x * x)).alias("norm"))


def accumulated(rows: DataFrame, step_col: str, loss_col: str, tokens_col: str) -> DataFrame:
    """Per step: the mean over tokens, and the mean of the micro-batches' means."""
    loss, n = F.col(loss_col), F.col(tokens_col)
    return rows.groupBy(step_col).agg((F.sum(loss) / F.greatest(F.sum(n), F.lit(1))).alias("token_mean"), F.avg(loss / F.greatest(n, F.lit(1))).alias("microbatch_mean"))


def cosine_rate(step: Column, total: int, peak: float, floor: float = 0.0) -> Column:
    done = F.least(step / F.lit(max(total, 1)), F.lit(1.0))
    return floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))


def warm_rate(step: Column, total: int, peak: float, warmup: int, kind: str = "linear") -> Column:
    """Rises over ``warmup`` steps, then falls to 0, in a line or a half cosine."""
    done = F.least(F.greatest(step - warmup, F.lit(0)) / F.lit(max(total - warmup, 1)), F.lit(1.0))
    fall = peak * (1 - done) if kind == "linear" else peak * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, peak * step / F.lit(max(warmup, 1))).otherwise(fall)


def adamw(rows: DataFrame, step: int, rate: float, betas: tuple[float, float] = (0.9, 0.95), eps: float = 1e-8, decay: float = 0.1, clip: float = 1.0) -> DataFrame:
    """One clipped AdamW update of rows (leaf, idx, g, p, m, v, decayed): new p, m, v; the norm is over all rows."""
    norm = rows.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("__norm"))
    g = F.col("g") * F.least(F.lit(1.0), clip / (F.col("__norm") + 1e-6))
    m = betas[0] * F.col("m") + (1 - betas[0]) * g
    v = betas[1] * F.col("v") + (1 - betas[1]) * g * g
    move = (m / (1 - betas[0] ** step)) / (F.sqrt(v / (1 - betas[1] ** step)) + eps)
    p = F.col("p") - rate * (move + F.when(F.col("decayed"), decay * F.col("p")).otherwise(0.0))
    return rows.join(F.broadcast(norm)).select("leaf", "idx", p.alias("p"), m.alias("m"), v.alias("v"))


def logged_step(step: Column) -> Column:
    """The first step, every fifth up to 20, and every twentieth after."""
    return (step == 1) | (step <= 20) & (step % 5 == 0) | (step % 20 == 0)


def true_mass_means(rows: DataFrame, mc1: Column, mc2: Column) -> DataFrame:
    """One row: mc1, mc2, n; nulls without rows."""
    return rows.agg(F.avg(mc1.cast("int")).alias("mc1"), F.avg(mc2).alias("mc2"), F.count("*").alias("n"))


def instruction_accuracies(rows: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """One row of two arrays of flags a prompt: prompt- and instruction-level accuracy, strict and loose; a prompt without instructions counts as followed."""
    each = []
    for name, flags in (("strict", strict), ("loose", loose)):
        each.append(F.avg(F.forall(flags, lambda x: x).cast("int")).alias(f"prompt_level_{name}_acc"))
        each.append((F.sum(F.size(F.filter(flags, lambda x: x))) / F.greatest(F.sum(F.size(flags)), F.lit(1))).alias(f"inst_level_{name}_acc"))
    return rows.agg(*each)


def masked_mean(loss: Column, mask: Column) -> Column:
    """Mean of a loss over the rows that the mask keeps; 0 without any."""
    return F.coalesce(F.sum(loss * mask) / F.greatest(F.sum(mask), F.lit(1)), F.lit(0.0))
