"""Array files against NumPy: byte ranges, headers, archives, writing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import corpus
from corvane.sources import arrays


def test_raw_and_headed_files_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    raw, row, matrix = rng.integers(0, 1 << 32, 1003, dtype=np.uint32), rng.integers(0, 60_000, 777).astype(np.uint16), rng.integers(0, 1 << 32, (97, 13), dtype=np.uint32)
    (tmp_path / "a.bin").write_bytes(raw.tobytes())
    np.save(tmp_path / "b.npy", row)
    np.save(tmp_path / "c.npy", matrix)
    np.save(tmp_path / "d.npy", matrix[:0])
    (tmp_path / "_hidden.bin").write_bytes(b"12345")
    rows = arrays.array_files(spark, str(tmp_path), range_bytes=400, row_tokens=30)
    assert rows.rdd.getNumPartitions() == 11 + 4 + 14
    out = rows.collect()
    own = lambda name: sorted((r.at, r.tokens) for r in out if r.path.endswith(name))
    for name, want in (("a.bin", raw), ("b.npy", row)):
        assert [x for _, t in own(name) for x in t] == want.tolist() and all(len(t) <= 30 for _, t in own(name))
        assert [at for at, _ in own(name)] == np.cumsum([0, *(len(t) for _, t in own(name))])[:-1].tolist()
    assert own("c.npy") == list(enumerate(matrix.tolist()))
    assert arrays.array_files(spark, f"file://{tmp_path}/a.bin", dtype="<u4").count() == 1


def test_archives(spark, tmp_path):
    ids, lengths = np.arange(60, dtype=np.int32).reshape(12, 5), np.arange(12, dtype=np.uint16)
    np.savez(tmp_path / "one.npz", input_ids=ids, lengths=lengths)
    np.savez_compressed(tmp_path / "two.npz", input_ids=ids + 1, lengths=lengths)
    rows = arrays.array_files(spark, str(tmp_path), members="input_ids").collect()
    assert sorted((r.path[-7:-4], r.at, r.tokens) for r in rows) == [*(("one", i, x) for i, x in enumerate(ids.tolist())), *(("two", i, x) for i, x in enumerate((ids + 1).tolist()))]
    assert {r.member for r in arrays.array_files(spark, f"{tmp_path}/one.npz").collect()} == {"input_ids.npy", "lengths.npy"}


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1234567")
    with pytest.raises(Exception, match="has 7 bytes"):
        arrays.array_files(spark, f"{tmp_path}/a.bin").collect()
    np.save(tmp_path / "f.npy", np.ones(3))
    with pytest.raises(Exception, match="whole numbers"):
        arrays.array_files(spark, f"{tmp_path}/f.npy").collect()
    np.save(tmp_path / "g.npy", np.asfortranarray(np.ones((3, 2), np.int32)))
    with pytest.raises(Exception, match="by columns"):
        arrays.array_files(spark, f"{tmp_path}/g.npy").collect()
    with pytest.raises(Exception, match="none"):
        arrays.array_files(spark, f"{tmp_path}/none").collect()


def test_shards_as_arrays(spark, tmp_path):
    rows = spark.range(53).select(F.col("id").alias("global_seq"), F.sequence(F.col("id"), F.col("id") + 3).alias("tokens")).repartition(5)
    placed = rows.select("tokens", *corpus.shard_place(F.col("global_seq"), 10))
    arrays.write_array_shards(placed, f"{tmp_path}/s", 6)
    for k in range(6):
        own = np.load(tmp_path / "s" / f"shard_{k:05d}.npy")
        assert own.dtype == np.uint32 and own.tolist() == [[i, i + 1, i + 2, i + 3] for i in range(10 * k, min(53, 10 * k + 10))]
    times = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("shard*")}
    arrays.write_array_shards(placed, f"{tmp_path}/s", 6, 4)
    assert {p.name for p in (tmp_path / "s").iterdir()} == {*times} and all(p.stat().st_mtime_ns == times[p.name] for p in (tmp_path / "s").glob("shard_0000[0-3]*"))
    back = arrays.array_files(spark, f"{tmp_path}/s", range_bytes=64)
    assert back.rdd.getNumPartitions() > 6 and sorted(r.tokens for r in back.collect()) == [[i, i + 1, i + 2, i + 3] for i in range(53)]
