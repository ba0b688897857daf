"""Sources: manifests, raw token files, shards, JSON lines, arrays and manifests, listings, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file or a folder of them: line_no is a place (file, block of the file, line in it) to order by, so that a large file is read in parts."""
    rows = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start")
    return rows.select(F.struct("file_name", "file_block_start", F.monotonically_increasing_id().alias("line")).alias("line_no"), F.col("value").alias("line"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores where their scan has fewer parts than there are cores, as a small file of one row group has; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines give nothing, malformed ones nulls."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, or the one row of a JSON object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed JSON objects under a folder with their file's name; malformed files go."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path, multiLine=True)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def shards(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Rows of a shard folder from global row ``start`` on; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("global_seq") >= start)


def check_manifest(manifest: dict, length: int) -> dict:
    """The manifest if its rows are in their global order and of the expected length; otherwise an error."""
    if not manifest.get("globally_preshuffled"):
        raise ValueError("the corpus has not been put into its global order")
    if manifest.get("max_length") != length:
        raise ValueError(f"rows of {manifest.get('max_length')} tokens, not {length}")
    return manifest


class Registry(dict):
    """Named specifications; a name that is missing raises with the names there are."""

    def __missing__(self, name: str):
        raise KeyError(f"unknown name {name!r}; known: {', '.join(sorted(self))}")


def from_row(rows: DataFrame, start: int, total: int, seq_col: str = "global_seq") -> DataFrame:
    """Rows from ``start`` on; a start past the end raises."""
    if start > total:
        raise ValueError(f"row {start} is past the end, {total}")
    return rows.filter(F.col(seq_col) >= start)


def dataset(spark: SparkSession, specs: Registry, name: str, split: str | None = None, max_samples: int | None = None, order_col: str = "id") -> DataFrame:
    """A named table by its specification: path, and if it has them subset (a folder), splits (a column) and a default split.

    A sample of ``max_samples`` rows is the first of the seeded shuffle.
    """
    from corvane.operators.items import shuffled_sample

    spec = specs[name]
    rows = spark.read.parquet("/".join([spec["path"], *filter(None, [spec.get("subset")])]))
    if "splits" in spec:
        rows = rows.filter(F.col(spec["splits"]) == (split or spec["split"]))
    return rows if max_samples is None else shuffled_sample(rows, rows.count(), max_samples, order_col)


def listing(spark: SparkSession, folder: str, suffix: str = "", parts: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, size) of a folder's files that end so and hold one of the parts, if any are given; names alone are listed, nothing is read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    found = [(f.getPath().toString(), f.getPath().getName(), f.getLen()) for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where) if f.isFile()]
    kept = sorted(x for x in found if x[1].endswith(suffix) and (not parts or any(p in x[1] for p in parts)))
    return spark.createDataFrame(kept, "path string, name string, size long")


def padded_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows written by ``write_padded``, with the attention mask made anew from their lengths: 0 may be a token."""
    rows = spark.read.parquet(path)
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda _, i: (i < F.col("length")).cast("int")))
