"""Chats: rendering, loss masks, truncation, padding, best-fit packing, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.scans import numbered, running

USER, ASSISTANT, SYSTEM = "<|user|>\n", "<|assistant|>\n", "<|system|>\n"


def messages(rows: DataFrame, chat_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per chat with its messages in turn order."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    return rows.groupBy(chat_col).agg(F.transform(F.sort_array(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render(messages: Column, bos: str = "<|endoftext|>", eos: str = "<|endoftext|>", generation_prompt: bool = False) -> Column:
    """The chat as text; a newline follows an assistant's end unless it is the last; unknown roles give nothing."""
    n = F.size(messages)
    text = lambda m: F.coalesce(m["content"], F.lit(""))

    def one(m: Column, i: Column) -> Column:
        answer = F.concat(F.lit(ASSISTANT), text(m), F.lit(eos), F.when(i + 1 < n, F.lit("\n")).otherwise(F.lit("")))
        return F.when(m["role"] == "system", F.concat(F.lit(SYSTEM), text(m), F.lit("\n"))).when(m["role"] == "user", F.concat(F.lit(USER), text(m), F.lit("\n"))).when(m["role"] == "assistant", answer).otherwise(F.lit(""))

    return F.concat(F.lit(bos), F.array_join(F.transform(messages, one), ""), F.lit(ASSISTANT if generation_prompt else ""))


def answer_spans(text: str, eos: str = "<|endoftext|>") -> list[tuple[int, int]]:
    """Character spans from after each assistant header to the end of the next eos; a header without one ends the search."""
    out, at = [], 0
    while (head := text.find(ASSISTANT, at)) >= 0:
        start = head + len(ASSISTANT)
        stop = text.find(eos, start)
        if stop < 0:
            break
        at = stop + len(eos)
        out.append((start, at))
    return out


def tokenize_chats(chats: DataFrame, encode: Callable[[str], tuple[list[int], list[int]]], max_length: int, bos_id: int | None, id_col: str = "conv_id", text_col: str = "text", eos: str = "<|endoftext|>") -> DataFrame:
    """ids, loss_mask, truncated, dropped of rendered chats.

    ``encode`` gives ids and the tokens' first characters.  A token counts if it begins in an
    answer span; chats are cut to max_length first and dropped if no token is left to learn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                ids, starts = encode(text or "")
                spans = answer_spans(text or "", eos)
                mask = [int(any(a <= s < b for a, b in spans)) for s in starts]
                if bos_id is not None and ids[:1] != [bos_id]:
                    ids, mask = [bos_id, *ids], [0, *mask]
                long, ids, mask = len(ids) > max_length, ids[:max_length], mask[:max_length]
                out.append((key, ids, mask, long and any(mask), not any(mask)))
            yield pd.DataFrame(out, columns=["id", "ids", "loss_mask", "truncated", "dropped"])

    kind = chats.schema[id_col].dataType.simpleString()
    return chats.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, loss_mask array<tinyint>, truncated boolean, dropped boolean").withColumnRenamed("id", id_col)


def padded(ids: Column, mask: Column, length: int) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, loss_mask), filled on the right with 0."""
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.greatest(length - F.size(x), F.lit(0))))
    ones = F.transform(ids, lambda _: F.lit(1))
    return fill(ids, 0).alias("input_ids"), fill(ones, 0).alias("attention_mask"), fill(mask.cast("array<int>"), 0).alias("loss_mask")


#: A run's items from ``low`` to ``high``, by their rank among those of their length, fill bins from ``bin`` on, ``per_bin`` in each.
_RUN = "len int, low long, high long, bin long, per_bin long, offset int, segment int"


def best_fit_runs(counts: list[tuple[int, int]], capacity: int) -> list[tuple]:
    """Best-fit decreasing of (length, count) items as runs (length, low, high, bin, per_bin, offset, segment).

    The longest go first, each into the fullest bin with room, of equal bins the first made.  Items of one length fill a bin as
    far as they fit before the next is fullest, so open bins are kept as intervals of neighbours with equal room and equally many
    items: a length adds three at most, and one that is filled has less than half its room left.  Work and result depend on the
    capacity, not on the items.
    """
    rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    open_, bins, out = 0, 0, []

    def put(room: int, first: int, end: int, items: int) -> None:
        nonlocal open_
        if room and first < end:
            heappush(rooms[room], (first, end, items))
            open_ |= 1 << room

    for length, n in sorted(counts, reverse=True):
        if length > capacity:
            raise ValueError(f"a row has {length} tokens; a bin has {capacity}")
        at = 0
        while at < n:
            fit = open_ >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                first, end, items = heappop(rooms[room])
                if not rooms[room]:
                    open_ ^= 1 << room
            else:
                room, first, items = capacity, bins, 0
                end = bins = bins + (-(-(n - at) // (capacity // length)) if length else 1)
            each = room // length if length else n - at
            whole = min(end - first, (n - at) // each)
            if whole:
                out.append((length, at, at + whole * each, first, each, capacity - room, items))
                put(room - each * length, first, first + whole, items + each)
            at, first = at + whole * each, first + whole
            if at < n and first < end:
                out.append((length, at, n, first, each, capacity - room, items))
                put(room - (n - at) * length, first, first + 1, items + n - at)
                at, first = n, first + 1
            put(room, first, end, items)
    return out


def pack_best_fit(rows: DataFrame, capacity: int, id_col: str = "row_id", len_col: str = "len", group_col: str | None = None) -> DataFrame:
    """(group,) id, bin, offset, segment: best-fit decreasing of the whole table, or within each group; ties by id.

    Only a group's histogram of lengths, ``capacity`` entries at most, is packed in one task.  Rows are ranked within their length by
    sorted blocks, and take their bin from the last run that begins at or before their rank, carried forward in the same way: no task and
    no driver holds the rows of a group or a length.
    """
    key = F.col(group_col) if group_col else F.lit(0)
    own = rows.select(key.alias("g"), F.col(id_col).alias("id"), F.col(len_col).cast("int").alias("len"))
    kind = own.schema["g"].dataType.simpleString()

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(best_fit_runs(list(zip(pdf["len"].tolist(), pdf["count"].tolist(), strict=True)), capacity), columns=["len", "low", "high", "bin", "per_bin", "offset", "segment"])
        return out.assign(g=pdf["g"].iloc[0])

    ranked = numbered(own, ["id"], ["g", "len"], "rank")
    plans = ranked.groupBy("g", "len").count().groupBy("g").applyInPandas(runs, f"{_RUN}, g {kind}")
    starts = plans.select("g", "len", F.col("low").alias("rank"), F.struct("low", "bin", "per_bin", "offset", "segment").alias("run"))
    steps = ranked.withColumns({"row": F.lit(1), "begins": F.lit(None).cast(starts.schema["run"].dataType)}).unionByName(starts.withColumnRenamed("run", "begins").withColumn("row", F.lit(0)), allowMissingColumns=True)
    out = running(steps, ["rank", "row"], lasts={"run": "begins"}, within=["g", "len"]).filter("row = 1")
    step = F.expr("(rank - run.low) % run.per_bin")
    out = out.select("g", "id", F.expr("run.bin + (rank - run.low) DIV run.per_bin").alias("bin"), (F.col("run.offset") + step * F.col("len")).cast("int").alias("offset"), (F.col("run.segment") + step).cast("int").alias("segment"))
    out = out.withColumnRenamed("id", id_col)
    return out.withColumnRenamed("g", group_col) if group_col else out.drop("g")


def next_targets(ids: Column, segments: Column | None = None) -> tuple[Column, Column]:
    """(targets, valid): the next token, 0 at the end; valid where the next token is of the same segment."""
    shift = lambda x, v: F.concat(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.array(F.lit(v).cast("int")))
    targets = F.when(F.size(ids) > 0, shift(ids, 0)).otherwise(ids)
    if segments is None:
        return targets.alias("targets"), F.transform(ids, lambda _, i: (i + 1 < F.size(ids)).cast("int")).alias("valid")
    valid = F.zip_with(segments, shift(segments, -2), lambda a, b: ((a == b) & (a >= 0)).cast("int"))
    return targets.alias("targets"), valid.alias("valid")


def split_context(full: Column, context: Column, length: int) -> tuple[Column, Column]:
    """(ids, first target) of context + continuation, both cut on the left to ``length``."""
    n = F.size(full)
    ids = F.slice(full, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    return ids.alias("ids"), F.least(F.least(F.size(context), F.lit(length)), F.size(ids)).alias("target_start")


def choice_prompt(question: Column, choices: Column, letters: str = "ABCDEFGHIJ", answer: bool = True) -> Column:
    """Question, a line for each choice, and ``Answer:``."""
    lines = F.transform(choices, lambda c, i: F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, letters)), i + 1), F.lit(". "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:" if answer else ""))


def few_shot_prefix(shots: DataFrame, group_cols: list[str], order_col: str, text_col: str, k: int) -> DataFrame:
    """(group, prefix): each group's first k shots joined by blank lines; groups are small tables to broadcast."""
    w = Window.partitionBy(*group_cols).orderBy(order_col)
    first = shots.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    listed = F.sort_array(F.collect_list(F.struct("__n", F.col(text_col).alias("t"))))
    return first.groupBy(*group_cols).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("prefix"))


def packed_rows(placed: DataFrame, rows: DataFrame, capacity: int, id_col: str = "row_id", group_col: str | None = None) -> DataFrame:
    """(group,) bin, input_ids, loss_mask, segment_ids, positions, labels, label_mask: the rows of bins from :func:`pack_best_fit`.

    ``rows``: id_col, ids, loss_mask.  Segments count from 0, -1 pads; positions start anew in each; a label is the next token, valid
    within its segment only.  A bin's pieces fit its capacity, so a group is small.
    """
    keys = [group_col] if group_col else []
    one = F.struct("offset", "segment", "ids", "loss_mask")
    bins = placed.join(rows.select(id_col, "ids", "loss_mask"), id_col).groupBy(*keys, "bin").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    flat = lambda f: F.flatten(F.transform("parts", f))
    pad = lambda x, v: F.concat(x, F.array_repeat(F.lit(v).cast("int"), F.lit(capacity) - F.size(x)))
    out = bins.select(
        *keys, "bin", pad(flat(lambda p: p["ids"]), 0).alias("input_ids"), pad(flat(lambda p: p["loss_mask"]), 0).alias("loss_mask"),
        pad(flat(lambda p: F.transform(p["ids"], lambda _: p["segment"])), -1).alias("segment_ids"), pad(flat(lambda p: F.transform(p["ids"], lambda _, i: i)), 0).alias("positions"),
    )
    labels, valid = next_targets(F.col("input_ids"), F.col("segment_ids"))
    return out.withColumns({"labels": labels, "label_mask": F.zip_with(valid, F.concat(F.slice("loss_mask", 2, capacity - 1), F.array(F.lit(0))), lambda a, b: a * b)})


def packing_statistics(placed: DataFrame, lengths: DataFrame, capacity: int, id_col: str = "row_id", group_col: str | None = None) -> DataFrame:
    """(group,) n_docs, n_bins, docs_per_bin, utilisation; one row without a group."""
    bins = F.count_distinct("bin")
    out = placed.join(lengths.select(id_col, "len"), id_col).groupBy(*([group_col] if group_col else [])).agg(F.count("*").alias("n_docs"), bins.alias("n_bins"), F.sum("len").alias("n_tokens"))
    return out.withColumns({"docs_per_bin": F.col("n_docs") / F.greatest("n_bins", F.lit(1)), "utilisation": F.col("n_tokens") / F.greatest(F.col("n_bins") * capacity, F.lit(1))})


def drop_counts(chats: DataFrame) -> DataFrame:
    """One row of tokenized chats: n, n_dropped, and n_truncated of those that stay."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return chats.agg(F.count("*").alias("n"), n(F.col("dropped")).alias("n_dropped"), n(~F.col("dropped") & F.col("truncated")).alias("n_truncated"))
