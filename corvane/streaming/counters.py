"""Running counters of training logs as stateful streams: tokens so far and throughput since a run's last log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.streaming.ordered import RowRanges

_OUT = "run string, step long, total_tokens long, steps long, seconds double, tokens_per_second double"
_STATE = "step long, micros long, total long"


def in_row_order(rows: DataFrame, total: int, rows_per_batch: int, seq_col: str) -> DataFrame:
    """``rows``, numbered by ``seq_col``, as a stream that brings them by ranges of their numbers and so can stop at any row."""
    spark = rows.sparkSession
    spark.dataSource.register(RowRanges)
    ranges = spark.readStream.format("row_ranges").options(total=str(total), rows=str(rows_per_batch)).load()
    return ranges.select(F.explode(F.sequence("first", F.col("last") - 1)).alias(seq_col)).join(rows, seq_col)


def running_counters(log: DataFrame, run_col: str, step_col: str, time_col: str, tokens_per_step: int) -> DataFrame:
    """run, step, total_tokens, steps, seconds, tokens_per_second of each logged step, from a stream that brings a run's logs in the order of their steps.

    A run's state is its last step and time and the tokens it has counted from step 0 on; it is kept in the stream's checkpoint, so that a
    restart goes on counting.  The first log of a run has no throughput; nor has one at the same time as the one before.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("step")
        step, micros = pdf["step"].to_numpy(), pdf["micros"].to_numpy()
        last, at, total = state.get if state.exists else (None, None, 0)
        before = [last, *step[:-1].tolist()]
        times = [at, *micros[:-1].tolist()]
        steps = [None if b is None else int(s) - b for s, b in zip(step, before, strict=True)]
        seconds = [None if t is None else (int(m) - t) / 1e6 for m, t in zip(micros, times, strict=True)]
        totals = total + pd.Series([s if d is None else d for s, d in zip(step.tolist(), steps, strict=True)]).cumsum() * tokens_per_step
        state.update((int(step[-1]), int(micros[-1]), int(totals.iloc[-1])))
        speed = [None if not s or s <= 0 else d * tokens_per_step / s for d, s in zip(steps, seconds, strict=True)]
        yield pd.DataFrame({"run": str(key[0]), "step": step, "total_tokens": totals.to_numpy(), "steps": pd.array(steps, "Int64"), "seconds": pd.array(seconds, "Float64"), "tokens_per_second": pd.array(speed, "Float64")})

    own = log.select(F.col(run_col).cast("string").alias("run"), F.col(step_col).cast("long").alias("step"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("micros"))
    return own.groupBy("run").applyInPandasWithState(one, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_all(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream has now to a table that holds each batch once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
