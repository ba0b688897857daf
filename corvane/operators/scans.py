"""Places, running sums and last values of rows in an order, in two levels: blocks of the sorted rows, then what each block carries on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import BROADCAST_BYTES, written

_AT = "__at"


def _sorted(rows: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of their order, sorted and written, with __at: the block in the upper bits, the place in it below."""
    keys = [*within, *order]
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "sorted")


def _block() -> Column:
    return F.shiftright(_AT, 33)


def _carried(rows: DataFrame, carries: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` with their block's carries, which are one row a block and group: as many as blocks and groups together at most."""
    small = carries.count() * (64 + 32 * len(carries.columns)) <= BROADCAST_BYTES
    on = [F.col("x.__block").eqNullSafe(F.col("y.__block")), *(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in within)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    own = rows.withColumn("__block", _block()).alias("x").join((F.broadcast(carries) if small else carries).alias("y"), condition)
    return own.select("x.*", *[F.col(f"y.{c}") for c in carries.columns if c not in ("__block", *within)])


def numbered(rows: DataFrame, order: list[str], within: list[str] | None = None, out: str = "at", size: str | None = None) -> DataFrame:
    """``rows`` with their place from 0 in the order, of each group of ``within`` if there is one; ``size``: a column for the group's rows.

    Rows are sorted by ranges, so a group of any size lies in as many blocks as it needs; only the blocks' counts are summed in order.
    Ties get places in any order; null groups and keys count as the smallest values.
    """
    within = within or []
    placed = _sorted(rows, order, within)
    counts = placed.groupBy(_block().alias("__block"), *within).agg(F.count("*").alias("__n"), F.min(_AT).alias("__low"))
    group = Window.partitionBy(*within)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__size": F.sum("__n").over(group)})
    own = _carried(placed, counts.drop("__n"), within).withColumn(out, F.col("__before") + F.col(_AT) - F.col("__low"))
    own = own.withColumn(size, F.col("__size")) if size else own
    return own.drop(_AT, "__block", "__low", "__before", "__size")


def running(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, within: list[str] | None = None) -> DataFrame:
    """``rows`` with running sums up to and without their own row (out: column) and last values so far that are not null, their own row's included.

    A window runs over a block's rows at a time, and one over the blocks' carries.  Ties are taken in any order.
    """
    within, sums, lasts = within or [], sums or {}, lasts or {}
    placed = _sorted(rows, order, within).withColumn("__block", _block())
    own = Window.partitionBy("__block", *within)
    inside = own.orderBy(_AT)
    local = {f"__{out}": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for out, c in sums.items()}
    local |= {f"__{out}": F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for out, c in lasts.items()}
    totals = [F.sum(c).alias(f"__{out}") for out, c in sums.items()] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_AT))).alias(f"__{out}") for out, c in lasts.items()]
    carries = placed.groupBy("__block", *within).agg(F.count("*").alias("__n"), *totals)
    before = Window.partitionBy(*within).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__carry_{out}": F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)) for out in sums} | {f"__carry_{out}": F.last(f"__{out}", ignorenulls=True).over(before) for out in lasts}
    carries = carries.select("__block", *within, *[x.alias(n) for n, x in carried.items()])
    out = _carried(placed.withColumns(local).drop("__block"), carries, within)
    out = out.withColumns({o: F.col(f"__{o}") + F.col(f"__carry_{o}") for o in sums} | {o: F.coalesce(f"__{o}", f"__carry_{o}") for o in lasts})
    return out.drop(_AT, "__block", *[f"__{o}" for o in (*sums, *lasts)], *carried)
