"""Tables in the folder that driver and executors share: where a plan's lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Intermediate tables have no marker file: only the job that wrote one reads it.
_PLAIN = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without that setting a temporary one, and only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corvane-")
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows``, written to the shared folder and read from there."""
    path = shared_path(rows.sparkSession, label)
    rows.write.options(**_PLAIN).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
