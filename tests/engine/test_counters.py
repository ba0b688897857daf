"""Stateful counters against plain Python and the batch window, with a restart between two rows of one run."""

import datetime
import random

from pyspark.sql import functions as F

from corvane.operators import corpus
from corvane.streaming.counters import in_row_order, running_counters, write_all


def test_counters_survive_a_restart(spark, tmp_path):
    rng = random.Random(3)
    step, rows, base = {}, [], datetime.datetime(2024, 1, 1)
    for i in range(60):
        run = rng.choice(["a", "b", None])
        step[run] = step.get(run, 0) + rng.randrange(1, 5)
        rows.append((i, run, step[run], base + datetime.timedelta(seconds=i // 2)))
    spark.createDataFrame(rows, "seq long, run string, step long, at timestamp").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    for total in (23, 60):  # the second run goes on where the first one stopped
        write_all(running_counters(in_row_order(log, total, 10, "seq"), "run", "step", "at", 8), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.read.parquet(f"{tmp_path}/out").count() == total
    got = {(r.run, r.step): (r.total_tokens, r.steps, r.seconds, r.tokens_per_second) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = corpus.throughput(log.withColumn("run", F.coalesce(F.col("run"), F.lit("None"))), "run", "step", "at", 8)
    assert got == {(r.run, r.step): (r.step * 8, r.steps, r.seconds, r.tokens_per_second) for r in want.collect()}
