"""Corpora and chats against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.operators import chat, corpus


def test_manifest(spark):
    lines = ["", "s3://b/a.npy", "#SOURCE: x/y extra", "s3://b/c.npy", "# note", "  s3://b/d.npy"]
    rows = corpus.manifest(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("file_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "unknown", "https://b/a.npy"), (1, "x/y", "https://b/c.npy"), (2, "x/y", "https://b/d.npy")]


def test_pack_fixed(spark):
    files = [(0, []), (1, [1] * 3), (2, list(range(4))), (3, list(range(11)))]
    rows = corpus.pack_fixed(spark.createDataFrame(files, "file_idx int, tokens array<int>"), 4).orderBy("global_seq").collect()
    assert [(r.file_idx, r.seq_in_file, r.global_seq, r.tokens) for r in rows] == [(2, 0, 0, [0, 1, 2, 3]), (3, 0, 1, [0, 1, 2, 3]), (3, 1, 2, [4, 5, 6, 7])]
    assert corpus.pack_fixed(spark.createDataFrame(files, "file_idx int, tokens array<int>"), 4, 9).count() == 2


def test_global_order(spark):
    want = np.arange(50, dtype=np.uint32)
    np.random.Generator(np.random.PCG64(42)).shuffle(want)
    rows = corpus.shuffle_globally(spark.range(50).withColumnRenamed("id", "global_seq"), 50, 42, 8).orderBy("out_pos").collect()
    assert [r.global_seq for r in rows] == want.tolist() and [r.shard_id for r in rows] == [i // 8 for i in range(50)]
    assert corpus.shard_sizes(50, 8) == [8] * 6 + [2]


def repeated(a, most_period=13, count=32):
    if -1 in a:
        return False
    for p in range(1, min(most_period, len(a) // 3) + 1):
        for s in range(len(a) - p * count + 1):
            if all(a[s + k] == a[s + k % p] for k in range(p * count)):
                return True
    return False


def test_repetition(spark):
    rng = random.Random(1)
    cases = [[], [1] * 31, [1] * 32, [7, 8] * 32, ([1, 2, 3] * 40)[: 3 * 31 + 2], list(range(13)) * 32, [5] * 40 + [-1], [1, 2] * 15]
    cases += [[rng.randrange(2) for _ in range(5)] + [rng.randrange(3) for _ in range(rng.randrange(1, 4))] * rng.randrange(28, 36) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t array<int>").select("i", corpus.repeats_too_much(F.col("t")).alias("bad")).collect()
    assert {r.i: r.bad for r in rows} == {i: repeated(c) for i, c in enumerate(cases)}


def test_batches_and_resume(spark):
    rows = spark.range(37).withColumnRenamed("id", "global_seq")
    assert corpus.batches(rows, 37, 8).count() == 32
    assert corpus.resume_row(rows.filter("global_seq % 2 = 1"), 5).first()[0] == 10
    order = corpus.epoch_order(spark, 10, 4, 5, 3).collect()
    rng = np.random.default_rng(3)
    first, second = rng.permutation(10), rng.permutation(10)
    assert [r.row_id for r in order] == [*first[:8], *second[:8], *rng.permutation(10)[:4]]
    with pytest.raises(ValueError):
        corpus.epoch_order(spark, 3, 4, 1, 0)


def test_an_epoch_order_is_not_broadcast(spark):
    """A join with it shuffles: the driver holds no order."""
    order = corpus.epoch_order(spark, 1000, 4, 500, 3)
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    joined = order.join(rows, "row_id").groupBy("step").count()
    assert joined.count() == 500 and "Broadcast" not in joined._jdf.queryExecution().toString()


def test_render_and_mask(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (1, 3, "tool", "no"), (1, 4, "assistant", "B"), (2, 0, "user", "only")]
    chats = chat.messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    text = {r[0]: r[1] for r in chats.select("conv_id", chat.render(F.col("messages"), "<b>", "<e>")).collect()}
    assert text[1] == "<b><|system|>\nS\n<|user|>\nU\n<|assistant|>\nA<e>\n<|assistant|>\nB<e>"
    assert [text[1][a:b] for a, b in chat.answer_spans(text[1], "<e>")] == ["A<e>", "B<e>"]
    assert chat.answer_spans("<|assistant|>\nno end", "<e>") == []
    df = spark.createDataFrame(list(text.items()), "conv_id int, text string")
    out = {r.conv_id: r for r in chat.tokenize_chats(df, lambda t: ([ord(c) for c in t], list(range(len(t)))), 1000, 0, eos="<e>").collect()}
    assert sum(out[1].loss_mask) == 8 and out[1].ids[0] == 0 and out[2].dropped and not out[1].truncated


def plain_best_fit(rows, capacity):
    bins, out = [], {}
    for key, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        fit = [(room, b) for b, room in enumerate(bins) if room >= n and room > 0]
        b = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append(capacity)
        out[key] = (b, capacity - bins[b])
        bins[b] -= n
    return out


def test_best_fit(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 33)) for i in range(200)]
    found = {r.row_id: (r.bin, r.offset) for r in chat.pack_best_fit(spark.createDataFrame(rows, "row_id int, len int"), 32).collect()}
    assert found == plain_best_fit(rows, 32)


def test_best_fit_runs_equal_the_sequential_packer(spark):
    rng = random.Random(6)
    for capacity, n, most in ((7, 60, 7), (32, 300, 32), (32, 300, 5), (100, 500, 100), (64, 1, 64), (10, 40, 1)):
        rows = [(i, rng.randrange(1, most + 1)) for i in range(n)]
        runs = chat.best_fit_runs(list(Counter(x for _, x in rows).items()), capacity)
        rank, found = Counter(), {}
        for key, x in sorted(rows):
            r = next(r for r in runs if r[0] == x and r[1] <= rank[x] < r[2])
            step = (rank[x] - r[1]) % r[4]
            found[key] = (r[3] + (rank[x] - r[1]) // r[4], r[5] + step * x)
            rank[x] += 1
        assert found == plain_best_fit(rows, capacity)
    many = chat.best_fit_runs([(x, 10**9 + x) for x in range(1, 2049)], 2048)
    assert sum(r[2] - r[1] for r in many) == sum(10**9 + x for x in range(1, 2049)) and len(many) < 3 * 2048 * 11


def test_best_fit_in_groups_and_empty_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a", "b"]), rng.randrange(1, 17)) for i in range(90)]
    out = chat.pack_best_fit(spark.createDataFrame(rows, "row_id int, g string, len int").repartition(3), 16, group_col="g").collect()
    for g in (None, "a", "b"):
        assert {r.row_id: (r.bin, r.offset) for r in out if r.g == g} == plain_best_fit([(i, n) for i, k, n in rows if k == g], 16)
    out = {r.row_id: tuple(r)[1:] for r in chat.pack_best_fit(spark.createDataFrame([(1, 0), (2, 16), (3, 0), (4, 9)], "row_id int, len int"), 16).collect()}
    assert out == {2: (0, 0, 0), 4: (1, 0, 0), 1: (1, 9, 1), 3: (1, 9, 2)}
    assert chat.pack_best_fit(spark.createDataFrame([], "row_id int, len int"), 16).count() == 0


def test_baked_shards_hold_the_seeded_order(spark, tmp_path):
    n, size = 103, 10
    rows = spark.range(n).select(F.col("id").alias("global_seq"), (F.col("id") * 7).alias("x")).repartition(4)
    folder = f"{tmp_path}/baked"
    placed = corpus.shuffle_globally(rows, n, 42, size)
    broken = placed.filter("shard_id <> 8")
    with pytest.raises(ValueError, match="shard 8 has 0 of 10"):
        corpus.bake(broken, folder, n, size, 4)
    done = sorted(p.name for p in (tmp_path / "baked").iterdir() if p.name.endswith("COMPLETE"))
    assert done == ["_batch_0000000_4_COMPLETE", "_batch_0000004_4_COMPLETE"]
    before = {p: p.stat().st_mtime_ns for k in (0, 4) for p in (tmp_path / "baked" / f"batch={k}").rglob("*.parquet")}
    out = corpus.bake(placed, folder, n, size, 4)
    assert out.count() == n and all(p.stat().st_mtime_ns == t for p, t in before.items()), "whole batches are not written again"
    order = np.arange(n, dtype=np.uint32)
    np.random.Generator(np.random.PCG64(42)).shuffle(order)
    for shard in range(11):
        files = list((tmp_path / "baked").glob(f"batch=*/shard_id={shard}/*.parquet"))
        assert len(files) == 1 and pq.read_table(files[0], partitioning=None).column("global_seq").to_pylist() == order[shard * size : (shard + 1) * size].tolist()


def test_baked_shards_take_few_jobs(spark, tmp_path, monkeypatch):
    """Many batches of few shards are written together, each with its marker; several jobs hold the same rows, and what a broken run left is written anew."""
    n, size = 400, 4
    rows = spark.range(n).select(F.col("id").alias("global_seq"))
    order = np.arange(n, dtype=np.uint32)
    np.random.Generator(np.random.PCG64(42)).shuffle(order)
    drawn = []
    exists = corpus.exists
    monkeypatch.setattr(corpus, "underfilled", lambda *a, f=corpus.underfilled: drawn.append(a[3:]) or f(*a))
    for shards, jobs in ((4096, 1), (30, 4)):
        monkeypatch.setattr(corpus, "_JOB_SHARDS", shards)
        folder = f"{tmp_path}/few-{shards}"
        placed = corpus.shuffle_globally(rows, n, 42, size)
        assert "Broadcast" not in placed.groupBy("shard_id").count()._jdf.queryExecution().toString()
        with pytest.raises(ValueError, match="shard 0 has 3 of 4"):
            corpus.bake(placed.filter("out_pos <> 2"), folder, n, size, 7)
        drawn.clear()
        out = corpus.bake(placed, folder, n, size, 7)
        assert len(drawn) == jobs and {r.out_pos: r.global_seq for r in out.collect()} == dict(enumerate(order.tolist())) and out.count() == n
        assert all(exists(spark, f"{folder}/_batch_{k:07d}_{min(7, 100 - k)}_COMPLETE") for k in range(0, 100, 7))
        assert all(len(list((tmp_path / f"few-{shards}").glob(f"batch=*/shard_id={k}/*.parquet"))) == 1 for k in range(100))


def plain_runs(x, low, high):
    out = []
    for p in range(low, min(high, len(x) // 3) + 1):
        i = p
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - p]:
                j += 1
            if (j - i + p) // p > 2:
                out.append((i - p, j, p, (j - i + p) // p))
            i = max(j, i) + 1
    return out


def test_periodic_runs(spark):
    rng = random.Random(14)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(80))] for _ in range(60)]
    seqs += [[1] * 50, [1, 2] * 30 + [9] + [4, 5, 6] * 20, list(range(13)) * 4, [1, -1] * 20, [], None]
    out = corpus.periodic_runs(spark.createDataFrame(list(enumerate(seqs)), "id int, tokens array<int>"), "id")
    assert sorted(map(tuple, out.collect())) == sorted((i, *r) for i, x in enumerate(seqs) if x and -1 not in x for r in plain_runs(x, 1, 13))


def test_targets_and_context(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [0, 0, 1, -1]), ([], [])], "t array<int>, s array<int>")
    rows = df.select(*chat.next_targets(F.col("t"), F.col("s"))).collect()
    assert rows[0].targets == [6, 7, 8, 0] and rows[0].valid == [1, 0, 0, 0] and rows[1].targets == []
    ids, start = chat.split_context(F.col("t"), F.slice("t", 1, 2), 3)
    assert tuple(df.select(ids, start).first()) == ([6, 7, 8], 2)
