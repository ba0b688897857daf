"""Rows streamed in their order, resumable at any row, into a sink that takes each batch once; windows over event streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from corvane.operators.corpus import repeats_too_much
from corvane.sources.writers import delete, exists, get_text, names_in, put_text, rename


class RowRanges(DataSource):
    """A stream of ranges of global rows: (at, cycle, first, last), ``rows`` rows a batch.

    The offset is the number of rows passed since row ``start`` of the first cycle, so a stream stops and starts again at any row, inside a shard
    too; every cycle begins at ``start`` again.  Options: total, start, rows, cycles, and ``at``, where a stream without a checkpoint begins.
    """

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        return "at long, cycle long, first long, last long"

    def simpleStreamReader(self, schema) -> _RangeReader:
        return _RangeReader({k: int(v) for k, v in self.options.items() if k in ("total", "start", "rows", "cycles", "at")})


class _RangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, int]) -> None:
        self.start, self.rows, self.begin = options.get("start", 0), options["rows"], options.get("at", 0)
        self.length = options["total"] - self.start
        if self.length < 0:
            raise ValueError(f"row {self.start} is past the end, {options['total']}")
        self.end = self.length * options.get("cycles", 1)

    def initialOffset(self) -> dict:
        return {"at": self.begin}

    def _between(self, at: int, end: int) -> Iterator[tuple]:
        out = []
        while at < end:
            cycle, row = divmod(at, self.length)
            n = min(end - at, self.length - row)
            out.append((at, cycle, self.start + row, self.start + row + n))
            at += n
        return iter(out)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["at"], min(start["at"] + self.rows, self.end))
        return self._between(start["at"], end), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(start["at"], end["at"])


class BatchSink:
    """A folder of batches, each named by the place it begins at and published once, together with the place to go on from.

    A batch is written aside, renamed, and then named by a marker that holds the next place; the marker is whole from the moment it exists.
    What a crash left without one is replaced, and a batch that has one is not taken again, so rows appear once whether a run
    fails before, between or after these steps.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _marker(self, at: int) -> str:
        return f"{self.folder}/_published/{at:020d}.json"

    def last(self) -> dict | None:
        """What the marker of the last batch holds."""
        names = sorted(n for n in names_in(self.spark, f"{self.folder}/_published") if n.endswith(".json"))
        return json.loads(get_text(self.spark, f"{self.folder}/_published/{names[-1]}")) if names else None

    def resume_at(self) -> int:
        done = self.last()
        return done["next"] if done else 0

    def take(self, rows: DataFrame, at: int, following: int, **meta) -> bool:
        """Publish ``rows`` as the batch from ``at`` to before ``following``; whether this call did."""
        if exists(self.spark, self._marker(at)):
            return False
        aside, final = f"{self.folder}/_aside/{at}", f"{self.folder}/batch={at}"
        rows.write.mode("overwrite").parquet(aside)
        delete(self.spark, final)
        rename(self.spark, aside, final)
        self._publish(at, {"at": at, "next": following, **meta})
        return True

    def _publish(self, at: int, meta: dict) -> None:
        put_text(self.spark, f"{self.folder}/_aside/{at}.json", json.dumps(meta))
        rename(self.spark, f"{self.folder}/_aside/{at}.json", self._marker(at))

    def rows(self, schema: str) -> DataFrame:
        """All published rows, with their batch; only the last folder can lack its marker."""
        done = self.last()
        out = self.spark.read.schema(f"{schema}, batch long").parquet(self.folder)
        return out.filter(F.col("batch") <= (done["at"] if done else -1))


def follow(rows: DataFrame, total: int, take: Callable[..., object], checkpoint: str, start: int = 0, rows_per_batch: int = 10_000, cycles: int = 1, at: int = 0, drop_repeats: bool = False, seq_col: str = "global_seq", tokens_col: str = "tokens", shard_size: int | None = None) -> None:
    """Feed ``rows``, numbered by ``seq_col``, to ``take(batch, at, following)`` in their order, until ``cycles`` passes from row ``start`` on are over.

    A batch is a range of rows whatever their files are; it has a column cycle, and its rows are sorted by cycle and number, over parts that
    follow each other.  Rows with too long repeats are dropped on demand and still count in the offset.  Shards outside a range are not
    opened if ``shard_size`` is given and rows have their shard_id.  Without a checkpoint the stream begins at ``at``, say
    where a :class:`BatchSink` resumes.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RowRanges)
    options = {"total": total, "start": start, "rows": rows_per_batch, "cycles": cycles, "at": at}
    ranges = spark.readStream.format("row_ranges").options(**{k: str(v) for k, v in options.items()}).load()

    def one(batch: DataFrame, epoch: int) -> None:
        found = sorted(map(tuple, batch.collect()))  # a row a cycle that the batch touches
        if not found:
            return
        part = None
        for _, cycle, first, last in found:
            own = rows.filter((F.col(seq_col) >= first) & (F.col(seq_col) < last))
            if shard_size:
                own = own.filter(F.col("shard_id").between(first // shard_size, (last - 1) // shard_size))
            own = own.withColumn("cycle", F.lit(cycle).cast("long"))
            part = own if part is None else part.unionByName(own)
        part = part.filter(~repeats_too_much(F.col(tokens_col))) if drop_repeats else part
        take(part.repartitionByRange("cycle", seq_col).sortWithinPartitions("cycle", seq_col), found[0][0], found[-1][0] + found[-1][3] - found[-1][2])

    stream = ranges.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()


def windowed_counts(events: DataFrame, ts_col: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """Counts and sums by tumbling window and keys; rows later than ``late`` go."""
    value = F.lit(1) if value is None else value
    rows = events.withWatermark(ts_col, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts_col, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
