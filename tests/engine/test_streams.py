"""Ordered streams and the sink that takes each batch once, with crashes at every step."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import corpus
from corvane.sources import writers
from corvane.streaming.ordered import BatchSink, _RangeReader, follow


def shards(spark, path, n=100, size=16):
    rows = spark.range(n).select(F.col("id").alias("global_seq"), F.when(F.col("id") % 9 == 4, F.array_repeat(F.lit(1), 40)).otherwise(F.sequence(F.col("id"), F.col("id") + 39).cast("array<int>")).alias("tokens"))
    shard, row = corpus.shard_place(F.col("global_seq"), size)
    writers.write_shards(rows.select("*", shard, row), path, -(-n // size))
    return spark.read.schema("global_seq long, tokens array<int>, row_in_shard long, shard_id long").parquet(path)


def stored(sink):
    """(batch, cycle, number) in the order of the files' rows."""
    rows = sink.rows("global_seq long, cycle long").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return [(r.batch, r.cycle, r.global_seq) for r in rows.orderBy("batch", "file", "row").collect()]


def expected(start, total, cycles, rows, keep=lambda i: True):
    n = total - start
    return [(k // rows * rows, k // n, start + k % n) for k in range(n * cycles) if keep(start + k % n)]


def test_ranges():
    reader = _RangeReader({"total": 10, "start": 3, "rows": 5, "cycles": 2})
    at, out = reader.initialOffset(), []
    while True:
        rows, after = reader.read(at)
        if after == at:
            break
        out += [*rows]
        assert [*reader.readBetweenOffsets(at, after)] == out[-len([*reader.readBetweenOffsets(at, after)]) :]
        at = after
    assert out == [(0, 0, 3, 8), (5, 0, 8, 10), (7, 1, 3, 6), (10, 1, 6, 10)]
    assert [*_RangeReader({"total": 3, "start": 3, "rows": 5, "cycles": 4}).read({"at": 0})[0]] == []
    with pytest.raises(ValueError, match="past the end"):
        _RangeReader({"total": 3, "start": 4, "rows": 5})


def test_order_and_cycles(spark, tmp_path):
    rows, sink = shards(spark, f"{tmp_path}/in"), BatchSink(spark, f"{tmp_path}/out")
    follow(rows, 100, lambda b, at, following: sink.take(b.select("global_seq", "cycle"), at, following), f"{tmp_path}/state", 7, 50, 2, shard_size=16)
    assert stored(sink) == expected(7, 100, 2, 50) and sink.resume_at() == 186


def test_dropped_rows_count_in_the_offset(spark, tmp_path):
    rows, sink = shards(spark, f"{tmp_path}/in"), BatchSink(spark, f"{tmp_path}/out")
    follow(rows, 100, lambda b, at, following: sink.take(b.select("global_seq", "cycle"), at, following), f"{tmp_path}/state", rows_per_batch=40, drop_repeats=True)
    assert stored(sink) == expected(0, 100, 1, 40, lambda i: i % 9 != 4) and sink.resume_at() == 100


@pytest.mark.parametrize("step", ["aside", "renamed", "published"])
@pytest.mark.parametrize("checkpoint", ["kept", "lost"])
def test_a_crash_leaves_no_row_twice(spark, tmp_path, step, checkpoint):
    """The run fails in its second batch after a step of the sink, before the stream has noted the batch; another run goes on."""
    rows = shards(spark, f"{tmp_path}/in")

    class Failing(BatchSink):
        def _publish(self, at, meta):
            if at == 30 and step == "renamed":
                raise RuntimeError("crash")
            super()._publish(at, meta)
            if at == 30 and step == "published":
                raise RuntimeError("crash")

    def take(sink):
        def run(batch, at, following):
            if at == 30 and step == "aside" and isinstance(sink, Failing):
                batch.select("global_seq", "cycle").write.mode("overwrite").parquet(f"{tmp_path}/out/_aside/{at}")
                raise RuntimeError("crash")
            sink.take(batch.select("global_seq", "cycle"), at, following)

        return run

    with pytest.raises(Exception, match="crash"):
        follow(rows, 100, take(Failing(spark, f"{tmp_path}/out")), f"{tmp_path}/state", 0, 30, shard_size=16)
    sink = BatchSink(spark, f"{tmp_path}/out")
    assert sink.resume_at() == (60 if step == "published" else 30) and stored(sink) == expected(0, 100, 1, 30)[: sink.resume_at()]
    state = f"{tmp_path}/state" if checkpoint == "kept" else f"{tmp_path}/new"
    follow(rows, 100, take(sink), state, 0, 30, at=sink.resume_at(), shard_size=16)
    assert stored(sink) == expected(0, 100, 1, 30) and sink.resume_at() == 100
