"""Raw token files and NumPy arrays as a data source: files are planned as byte ranges, so one of any size is read by many tasks; and written, an array a task."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Values that a task hands on at once, and of a range by default.
_CHUNK, RANGE_BYTES = 1 << 20, 64 << 20


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a local path or a URI that Arrow knows (file, s3, gs, hdfs)."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _header(stream) -> tuple[np.dtype, tuple[int, ...], int]:
    """Kind, shape and length of the header of an array file at its beginning."""
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    version = np.lib.format.read_magic(stream)
    if version not in read:
        raise ValueError(f"array files of version {version} are not known")
    shape, by_columns, kind = read[version](stream)
    if by_columns and len(shape) > 1:
        raise ValueError("arrays are read by rows; this one lies by columns")
    if len(shape) not in (1, 2) or kind.kind not in "iu":
        raise ValueError(f"an array of whole numbers in one or two dimensions is needed, not {kind} {shape}")
    return kind, shape, stream.tell()


@dataclass
class _Range(InputPartition):
    """Values from ``first`` on of a file, or of a member of an archive: ``count`` rows of ``width`` values, of the kind ``kind``, from byte ``begin``."""

    path: str
    member: str
    kind: str
    begin: int
    first: int
    count: int
    width: int
    matrix: bool


class ArrayFiles(DataSource):
    """``array_files``: (path, member, at, tokens) of the files under a path.

    Files that end in .npy have a header with their kind and shape, those that end in .npz are archives of such; any other is a raw run of
    values of the option ``dtype`` (<u4).  A matrix gives a row for each of its rows, with its number as ``at``; a run of values gives rows of at most
    ``row_tokens`` values (65,536), with the number of the first.  Ranges hold ``range_bytes`` bytes; a member of an archive, which may be compressed, is one range
    and read as a stream.  A file that ends inside a value is an error.  Other options: ``suffix`` of the files' names, ``members`` (comma-separated).
    """

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return "path string, member string, at long, tokens array<long>"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.dtype = np.dtype(options.get("dtype", "<u4"))
        self.range_bytes, self.row_tokens = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("row_tokens", 1 << 16))
        self.members = [m for m in options.get("members", "").split(",") if m]

    def partitions(self) -> list[_Range]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else sorted((f for f in fs.get_file_info(arrow_fs.FileSelector(path, recursive=True)) if f.is_file), key=lambda f: f.path)
        out = []
        for f in found:
            if f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_")):
                out += self._members(fs, f) if f.path.endswith(".npz") else self._ranges(fs, f)
        return out

    def _members(self, fs, f) -> list[_Range]:
        out = []
        with fs.open_input_file(f.path) as stream, zipfile.ZipFile(stream) as archive:
            for name in archive.namelist():
                if not self.members or name.removesuffix(".npy") in self.members:
                    with archive.open(name) as member:
                        kind, shape, begin = _header(member)
                    out.append(_Range(f.path, name, kind.str, begin, 0, shape[0], shape[1] if len(shape) == 2 else 1, len(shape) == 2))
        return out

    def _ranges(self, fs, f) -> list[_Range]:
        kind, begin, width, matrix = self.dtype, 0, 1, False
        if f.path.endswith(".npy"):
            with fs.open_input_file(f.path) as stream:
                kind, shape, begin = _header(stream)
            matrix, width = len(shape) == 2, shape[1] if len(shape) == 2 else 1
            n = shape[0]
        else:
            n = f.size // kind.itemsize
        size = kind.itemsize * width
        if f.size != begin + n * size:
            raise ValueError(f"{f.path} has {f.size} bytes, not the {begin + n * size} of its values")
        step = max(1, self.range_bytes // max(size, 1))
        return [_Range(f.path, "", kind.str, begin + at * size, at, min(step, n - at), width, matrix) for at in range(0, n, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        kind = np.dtype(partition.kind)
        size = kind.itemsize * partition.width
        rows = max(1, _CHUNK // max(partition.width, 1))
        with fs.open_input_file(partition.path) as file:
            if partition.member:
                stream = zipfile.ZipFile(file).open(partition.member)
                stream.read(partition.begin)
            else:
                stream = file
                stream.seek(partition.begin)
            for at in range(0, partition.count, rows):
                n = min(rows, partition.count - at)
                data = stream.read(n * size)
                if len(data) != n * size:
                    raise OSError(f"{partition.path} ended inside a range")
                values = np.frombuffer(data, kind).astype(np.int64)
                if partition.matrix:
                    ends, first = np.arange(n + 1) * partition.width, partition.first + at + np.arange(n)
                else:
                    ends = np.append(np.arange(0, n, self.row_tokens), n)
                    first = partition.first + at + ends[:-1]
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(first)), pa.array([partition.member] * len(first)), pa.array(first, pa.int64()), tokens], ["path", "member", "at", "tokens"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Rows (shard_id, tokens) as a matrix a shard, ``shard_{id:05d}.npy``, in the order they come in; files get their names when all are whole."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.dtype, self.columns = options["path"], np.dtype(options.get("dtype", "<u4")), columns
        if not {"shard_id", "tokens"} <= {*columns}:
            raise ValueError(f"shard_id and tokens are needed, not {columns}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        done: list[tuple[str, str]] = []
        now, parts = None, []

        def close() -> None:
            if parts:
                matrix = np.concatenate(parts).astype(self.dtype)
                aside, final = f"{path}/.{uuid.uuid4().hex}", f"{path}/shard_{now:05d}.npy"
                with fs.open_output_stream(aside) as out:
                    np.lib.format.write_array_header_1_0(out, {"descr": self.dtype.str, "fortran_order": False, "shape": matrix.shape})
                    out.write(memoryview(np.ascontiguousarray(matrix)).cast("B"))
                done.append((aside, final))
                parts.clear()

        for batch in iterator:
            shard, tokens = batch.column("shard_id").to_numpy(), batch.column("tokens")
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if shard[a] != now:
                    close()
                    now = int(shard[a])
                own = tokens.slice(a, b - a)
                parts.append(own.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for aside, final in m.files if m else ():
                fs.move(aside, final)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for aside, _final in m.files if m else ():
                fs.delete_file(aside)


def array_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Rows of :class:`ArrayFiles` under ``path``."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_array_shards(rows: DataFrame, path: str, n_shards: int, start_shard: int = 0, dtype: str = "<u4") -> None:
    """Rows (shard_id, row_in_shard, tokens of one length) as an array file a shard; shards before ``start_shard`` stay as they are.  A shard is held by its task."""
    rows.sparkSession.dataSource.register(ArrayFiles)
    own = rows.filter(F.col("shard_id") >= start_shard).withColumn("__to", (F.col("shard_id") - start_shard).cast("int"))
    own = own.repartitionById(max(1, n_shards - start_shard), F.col("__to")).sortWithinPartitions("shard_id", "row_in_shard").select("shard_id", "tokens")
    own.write.format("array_files").mode("append").option("path", path).option("dtype", dtype).save()
