"""Sinks: shards, manifests, summaries, cached results and commit markers, through Spark's own file systems."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder to where nothing stands yet, at once."""
    fs, where = _fs(spark, path)
    _, there = _fs(spark, to)
    fs.mkdirs(there.getParent())
    if not fs.rename(where, there):
        raise OSError(f"{path} could not be renamed to {to}")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none if it does not exist."""
    fs, where = _fs(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_shards(rows: DataFrame, path: str, n_shards: int, start_shard: int = 0) -> None:
    """One folder a shard, rows in shard order; only shards from ``start_shard`` on are written anew."""
    out = rows.filter(F.col("shard_id") >= start_shard).repartition(max(1, n_shards - start_shard), "shard_id").sortWithinPartitions("shard_id", "row_in_shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(path)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    put_text(spark, path, json.dumps(manifest, indent=2, sort_keys=True))


def write_summary(spark: SparkSession, folder: str, stamp: str, task: str, label: str, model_path: str, n: int, num_shots: int, metrics: dict) -> str:
    """A run's summary as ``{stamp}_{task}_{label}.json``; ``stamp`` is a UTC time like 20240102T030405Z."""
    when = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[9:11]}:{stamp[11:13]}:{stamp[13:15]}Z"
    path = f"{folder}/{stamp}_{task}_{label}.json"
    put_text(spark, path, json.dumps({"timestamp": when, "task": task, "label": label, "model_path": model_path, "n": n, "num_shots": num_shots, "metrics": metrics}))
    return path


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``path`` if a run completed it; otherwise it is made and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def commit(spark: SparkSession, folder: str, step: int, meta: dict) -> None:
    """A step's metadata, and its marker last, so that what has a marker is whole."""
    put_text(spark, f"{folder}/step_{step:07d}/meta.json", json.dumps(meta))
    put_text(spark, f"{folder}/step_{step:07d}_COMPLETE", "")


def latest_commit(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Step and metadata of the last whole commit; None without one.  Metadata that is missing counts as a fresh start."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return None
    names = {s.getPath().getName() for s in fs.listStatus(where)}
    steps = [int(n[5:12]) for n in names if n.startswith("step_") and n.endswith("_COMPLETE") and n.removesuffix("_COMPLETE") in names]
    if not steps or not exists(spark, f"{folder}/step_{max(steps):07d}/meta.json"):
        return None
    return max(steps), json.loads(get_text(spark, f"{folder}/step_{max(steps):07d}/meta.json"))


def write_padded(rows: DataFrame, path: str, mask_col: str = "attention_mask") -> None:
    """Padded rows with their lengths in place of the mask."""
    length = F.aggregate(mask_col, F.lit(0), lambda n, x: n + x.cast("int"))
    rows.withColumn("length", length).drop(mask_col).write.mode("overwrite").parquet(path)


def write_permutation(order: DataFrame, folder: str, seed: int) -> str:
    """The order of a shuffle as a table beside it, so that it can be checked."""
    path = f"{folder}/global_indices_seed{seed}"
    order.select("out_pos", "src_pos").write.mode("overwrite").parquet(path)
    return path


def cached_in_tiers(spark: SparkSession, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table under the first path where a run completed it, copied to those before it; otherwise it is made and written to all, the last one first."""
    at = next((i for i, p in enumerate(paths) if exists(spark, f"{p}/_SUCCESS")), len(paths))
    rows = make() if at == len(paths) else spark.read.parquet(paths[at])
    for path in reversed(paths[:at]):
        rows.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
    return rows


def once(spark: SparkSession, folder: str, step: int, run: Callable[[], dict]) -> bool:
    """Run and commit a step unless it or a later one is whole already; whether it ran."""
    done = latest_commit(spark, folder)
    if done and done[0] >= step:
        return False
    commit(spark, folder, step, run())
    return True
