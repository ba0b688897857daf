"""Results mart: summaries, latest runs, paired differences, leaderboards, coverage, Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = "timestamp string, task string, label string, model_path string, n long, num_shots int, metrics map<string, double>"


def parse_summaries(lines: DataFrame, body_col: str = "body") -> DataFrame:
    """Parsed summaries with the other columns; malformed ones go."""
    parsed = lines.withColumn("__s", F.from_json(body_col, SUMMARY, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("__s.task").isNotNull()).select(*[c for c in lines.columns if c != body_col], "__s.*")


def parse_name(name: Column, tasks: list[str], aliases: dict[str, str] | None = None) -> tuple[Column, Column, Column]:
    """(ts, task, label) of ``{stamp}_{task}_{label}.json``: the longest task that fits, under its canonical name."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.json$", "")
    ts, rest = F.substring_index(stem, "_", 1), F.regexp_replace(stem, "^[^_]*_", "")
    task, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t in sorted(tasks, key=len):
        fits = rest.startswith(t + "_")
        task = F.when(fits, F.lit((aliases or {}).get(t, t))).otherwise(task)
        label = F.when(fits, F.substring(rest, len(t) + 2, 1 << 30)).otherwise(label)
    return ts.alias("ts"), task.alias("task"), label.alias("label")


def latest(rows: DataFrame, keys: list[str], ts_col: str, order_col: str) -> DataFrame:
    """The latest row of each key; of equal stamps the first listed.  One partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts_col), -F.col(order_col)))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def paired_delta(rows: DataFrame, key: str, kind_col: str, value_col: str, before: str, after: str) -> DataFrame:
    """key, before, after and their difference in points with a sign; a dash where one is missing."""
    pick = lambda k: F.max(F.when(F.col(kind_col) == k, F.col(value_col)))
    out = rows.groupBy(key).agg(pick(before).alias("before"), pick(after).alias("after"))
    return out.withColumn("delta", signed_points(F.col("before"), F.col("after")))


def shown(v: Column) -> Column:
    """Four places; a dash for null."""
    return F.when(v.isNotNull(), F.format_string("%.4f", v)).otherwise(F.lit("—"))


def signed_points(before: Column, after: Column) -> Column:
    """The difference in points with its sign; a dash where either is null."""
    points = (after - before) * 100
    return F.when(points.isNotNull(), F.format_string("%+.1f", points)).otherwise(F.lit("—"))


def primary_metric(metrics: Column, names: list[str]) -> Column:
    """The first of the named metrics that there is."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def leaderboard(rows: DataFrame, task_col: str, value_col: str, order_col: str) -> DataFrame:
    """Rank within the task by falling value, the first listed first among equals; rows without a value go."""
    w = Window.partitionBy(task_col).orderBy(F.desc(value_col), order_col)
    return rows.filter(F.col(value_col).isNotNull()).withColumn("rank", F.row_number().over(w))


def coverage(rows: DataFrame, label_col: str, task_col: str, tasks: list[str]) -> DataFrame:
    return rows.filter(F.col(task_col).isin(*tasks)).groupBy(label_col).agg(F.countDistinct(task_col).alias("n_done"), F.lit(len(tasks)).alias("n_total"))


def markdown_rows(rows: DataFrame, columns: list[str], order: list) -> str:
    """A Markdown table of a small report."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    return "\n".join(head + [r[0] for r in rows.orderBy(*order).select(line).collect()])


def replace_block(document: str, name: str, block: str) -> tuple[str, bool]:
    """The document with the text between its markers replaced, or the block appended; and whether it changed."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    new = f"{start}\n{block}\n{end}"
    pattern = re.compile(re.escape(start) + ".*?" + re.escape(end), re.S)
    out = pattern.sub(lambda _: new, document, count=1) if pattern.search(document) else document.rstrip("\n") + "\n\n" + new + "\n"
    return out, out != document


def complete_steps(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Step numbers with both a folder and a commit marker."""
    name = F.regexp_replace(F.col(path_col), "/+$", "")
    step = lambda suffix: F.regexp_extract(name, rf"(?:^|/)step_(\d+){suffix}$", 1)
    has = lambda suffix: paths.select(step(suffix).alias("s")).select(F.expr("try_cast(s as long)").alias("step")).filter("step is not null").distinct()
    return has("").join(has("_COMPLETE"), "step", "left_semi")


def symmetric_closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs both ways and each member with itself."""
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return both.union(back).union(both.select("a", F.col("a").alias("b"))).union(back.select("a", F.col("a").alias("b"))).distinct()
