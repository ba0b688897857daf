"""Reports: labels, grids of results, target cards, unions of summaries, coverage, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.results import shown, signed_points

#: Labels that count, and the sign of a missing value.
CANONICAL = r"^(?:stage1_(?:240|500|1000|1200|1400|1600|1800|1907|final)k?|midtrained_(?:240|500|1000|1200|1400|1600|1800|1907|final)k|stage2_ingr[123]|main)$"
DASH = "—"
#: Metrics that stand in for a primary one that is missing.
SECOND_CHOICES = ("exact_match_flex", "micro_acc")


def canonical(label: Column) -> Column:
    return label.rlike(CANONICAL)


def checkpoint_label(path: Column) -> Column:
    """Label of a checkpoint: of a stored path the run and step, the part after the organisation, or the last folder; else the revision after ``@``.

    Runs under a ``midtrained`` folder get a prefix unless they have it.
    """
    bare = F.regexp_replace(path, "/+$", "")
    last, before = F.substring_index(bare, "/", -1), F.element_at(F.concat(F.array(F.lit("")), F.split(bare, "/")), -2)
    dashes = F.size(F.split(last, "--", -1)) - 1
    name = F.when(last.startswith("step_") & (before != ""), F.concat(before, F.lit("_"), last)).when(dashes >= 2, F.regexp_replace(last, "^.*?--", "")).otherwise(last)
    stored = F.when(path.contains("/midtrained/") & ~name.startswith("midtrain_"), F.concat(F.lit("midtrain_"), name)).otherwise(name)
    return F.when(path.startswith("gs://"), stored).otherwise(F.substring_index(path, "@", -1))


def split_revision(path: Column) -> tuple[Column, Column]:
    """(model, revision): what stands before and after the last ``@``; stored paths and paths without one have no revision."""
    plain = path.startswith("gs://") | ~path.contains("@")
    return F.when(plain, path).otherwise(F.regexp_replace(path, "@[^@]*$", "")).alias("model"), F.when(~plain, F.substring_index(path, "@", -1)).alias("revision")


def all_summaries(*tables: DataFrame) -> DataFrame:
    """Summaries of several places, by column name; a column that one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def primary_value(metrics: Column, primary: Column) -> Column:
    """The primary metric, or the first second choice that there is."""
    return F.coalesce(F.try_element_at(metrics, primary), *[F.try_element_at(metrics, F.lit(m)) for m in SECOND_CHOICES])


def label_grid(latest: DataFrame, labels: DataFrame, benches: DataFrame) -> DataFrame:
    """One row per label and bench, filled: label, task, header, target, value (null without a result), shown.

    ``latest``: (label, task, metrics); ``labels``: (label); ``benches``: (task, header, primary, target).  Labels and
    benches are short lists, so that their grid is small; results are joined to it.
    """
    grid = F.broadcast(labels.select("label").crossJoin(benches))
    found = latest.join(F.broadcast(labels.select("label")), "label", "left_semi").select("label", "task", "metrics")
    out = grid.join(found, ["label", "task"], "left").withColumn("value", primary_value(F.col("metrics"), F.col("primary")))
    return out.select("label", "task", "header", "target", "value", shown(F.col("value")).alias("shown"))


def target_differences(latest: DataFrame, card: DataFrame) -> DataFrame:
    """Results with the target of their bench and the distance to it in points; results of other benches go."""
    out = latest.join(F.broadcast(card), "task").withColumn("value", primary_value(F.col("metrics"), F.col("primary")))
    return out.select("label", "task", "header", "value", "target", ((F.col("value") - F.col("target")) * 100).alias("points"))


def task_labels(latest: DataFrame) -> DataFrame:
    """task and its map of labels to metrics."""
    return latest.groupBy("task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.col("value").alias("value"))))).alias("by_label"))


def step_pairs(rows: DataFrame, steps: list[str], before: str, after: str) -> DataFrame:
    """Every step of a fixed list with the values of its two labels, null where there is none, and the signed difference in points."""
    table = rows.sparkSession.createDataFrame(list(enumerate(steps)), "place int, step string")
    pick = lambda prefix, name: rows.select(F.col("label").alias(f"{name}_label"), F.col("value").alias(name))
    a, b = pick(before, "before"), pick(after, "after")
    out = table.join(a, F.concat(F.lit(before), "step") == F.col("before_label"), "left").join(b, F.concat(F.lit(after), "step") == F.col("after_label"), "left")
    return out.select("place", "step", "before", "after", signed_points(F.col("before"), F.col("after")).alias("delta"))


def comparison_report(title: str, grid: DataFrame, order: list[str], benches: list[tuple[str, str, str, float]], reproduced: dict[str, float | None]) -> str:
    """Markdown of a label by bench grid: targets, the reproduction, the labels in their order, and coverage.

    The grid has a cell for each label and bench of the report, so it is a few hundred rows.
    """
    cells = {(r.label, r.task): r for r in grid.collect()}
    line = lambda xs: "| " + " | ".join(xs) + " |"
    again = [DASH if reproduced.get(t) is None else f"*{reproduced[t]:.4f}*" for t, *_ in benches]
    out = [f"# {title}", "", line(["ckpt", *(h for _, h, _, _ in benches)]), "|" + "|".join(["---"] * (len(benches) + 1)) + "|"]
    out += [line(["**target**", *(f"**{x:.3f}**" for *_, x in benches)]), line(["*our repro*", *again])]
    out += [line([label, *(cells[label, t].shown for t, *_ in benches)]) for label in order]
    done = sum(cells[label, t].value is not None for label in order for t, *_ in benches)
    return "\n".join([*out, "", "## Coverage", "", f"{done}/{len(order) * len(benches)} cells filled."]) + "\n"


def results_table(rows: DataFrame, primary: str, extras: list[str]) -> DataFrame:
    """label, the primary metric and the extras as text, and the path, by falling primary metric; rows without it go."""
    value = F.try_element_at("metrics", F.lit(primary))
    text = lambda m: shown(F.try_element_at("metrics", F.lit(m)))
    return rows.filter(value.isNotNull()).orderBy(F.desc(value), "label").select("label", text(primary).alias(primary), *[text(m).alias(m) for m in extras], F.coalesce("model_path", F.lit(DASH)).alias("model_path"))


def without_exceptions(keys: DataFrame, exceptions: DataFrame, key_col: str) -> DataFrame:
    """For each row of ``exceptions`` (name, key): all keys but those named as its exceptions, and never itself."""
    names = exceptions.select("name").distinct()
    pairs = names.join(F.broadcast(keys.select(F.col(key_col).alias("key")).distinct()), F.col("name") != F.col("key"))
    return pairs.join(exceptions.select("name", "key"), ["name", "key"], "left_anti")


def reproduced(latest: DataFrame, benches: DataFrame, prefix: str) -> DataFrame:
    """Of each bench the latest result whose label begins so: task, label, value.  ``latest``: label, task, ts, metrics."""
    own = latest.filter(F.col("label").startswith(prefix)).groupBy("task").agg(F.max_by(F.struct("label", "metrics"), "ts").alias("best"))
    out = F.broadcast(benches.select("task", "primary")).join(own, "task", "left")
    return out.select("task", F.col("best.label").alias("label"), primary_value(F.col("best.metrics"), F.col("primary")).alias("value"))


def task_block(primary: str, pairs: DataFrame, rows: DataFrame, extras: list[str]) -> str:
    """Markdown of a task: the pairs of its steps, and all results by falling primary metric; both are short."""
    line = lambda xs: "| " + " | ".join(xs) + " |"
    number = lambda x: DASH if x is None else f"{x:.4f}"
    steps = [line([r.step, number(r.before), number(r.after), r.delta]) for r in pairs.orderBy("place").collect()]
    listed = [line([*r[:-1], f"`{r[-1]}`"]) for r in results_table(rows, primary, extras).collect()]
    heads = ["step", "stage1 (pretrain only)", "midtrained (50B Dolmino)", "Δ"], ["label", primary, *extras, "model_path"]
    return "\n".join(
        ["", f"### Pretrain → midtrain pairs (primary: `{primary}`)", "", line(heads[0]), "|" + "---|" * 4, *steps]
        + ["", "### All results (sorted by primary metric)", "", line(heads[1]), line(["---"] * len(heads[1])), *listed, ""]
    )
