"""Shared plumbing: cutting lineage into shared storage, and vectorised hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers and byte weights of the 64-bit hashes below.
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bytes of rows that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Intermediate tables are compressed and have no marker file: only the job that wrote one reads it.
_PLAIN = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written by :func:`cut` that are removed once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        out = cut(df, label)
        self.paths += [x.rsplit("/", 1)[0] for x in out.inputFiles()[:1]]
        return out

    def clear(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = []


def few(df: DataFrame, *keys: str, width: int | Column = 32) -> DataFrame:
    """``df``, to be broadcast if its rows' bytes allow it: those of ``keys`` and ``width`` for the other columns."""
    own = [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys]
    size = df.agg(F.coalesce(F.sum(sum(own, width if isinstance(width, Column) else F.lit(width))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Keys that may hold more than a ten-thousandth of all rows, and HEAVY at least, are joined by broadcast; there are at most as many.
HOT_KEYS, HEAVY = 10_000, 1_000


def joined_by(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, a row a key; a key that may hold more than a ten-thousandth of the rows (by ``n``) is broadcast, not shuffled."""
    heavy, light = (facts.filter(x) for x in (F.col(n) > max(HEAVY, total // HOT_KEYS), F.col(n) <= max(HEAVY, total // HOT_KEYS)))
    if not heavy.limit(1).count():
        return rows.join(facts, keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of the batches that go to Python workers and come back: of texts some megabytes.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """``spark``, with batches of at most BATCH_ROWS rows; Spark's default of 10,000 is no bound for texts."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """``run``, after which the worker, which Spark keeps for other tasks, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def giving_back(run: Callable) -> Callable:
    """A function of a batch's columns, after which the worker gives its free memory back."""

    @functools.wraps(run)
    def whole(*columns):
        try:
            return run(*columns)
        finally:
            release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers = {int(_B): np.ones(1, np.uint64), int(_INV): np.ones(1, np.uint64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n-1 modulo 2**64, kept for the process (its size is that of the longest input)."""
    have = _powers[int(base)]
    if len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P[i] = sum of weight(data[j]) * B**j over j < i, modulo 2**64; data: uint8."""
    with np.errstate(over="ignore"):
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(_BYTE[data] * _power(_B, len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each [start, end), whatever their place, from :func:`prefix_hash`."""
    with np.errstate(over="ignore"):
        body = (prefix[end] - prefix[start]) * _power(_INV, len(prefix))[start]
        return mix64(body + (end - start).astype(np.uint64) * _M2)


#: Hashes whose windows are compared at once; their places take the lower bits of a key.
STARTS = 1 << 23


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """Place of the least of each ``window`` neighbouring hashes (by their upper 40 bits), the last of equals; at most 2 * STARTS hashes."""
    mask, m = np.uint64(STARTS * 2 - 1), len(hashes)
    keys = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    keys[:m] = hashes & ~mask | mask - np.arange(m, dtype=np.uint64)
    # sliding minimum: the rest of one block of the window's size and the beginning of the next meet in each window
    grid = keys.reshape(-1, window)
    rest = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.minimum.accumulate(grid, axis=1).ravel()
    n = m - window + 1
    return (mask - (np.minimum(rest[:n], start[window - 1 : window - 1 + n]) & mask)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Whole numbers with all first bytes before all second ones: small numbers' zero bytes compress to nothing."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
