"""Token corpora: manifests, fixed-length packing, shards, seeded order, repetition filter, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.scans import running
from corvane.sources.shared import shared_path
from corvane.sources.writers import delete, exists, names_in, put_text


def manifest(lines: DataFrame, bucket_prefix: str = "s3://", url_prefix: str = "https://") -> DataFrame:
    """Ordered (file_idx, source, url) of manifest lines (line_no, line).

    A ``#SOURCE:`` line names the source of what follows; other lines that are not
    addresses are passed over.  The last name and the number of addresses so far are carried from block to block of the sorted lines.
    """
    text = F.trim("line")
    named = F.when(text.startswith("#SOURCE:"), F.split(F.trim(F.substring(text, 9, 1 << 30)), r"\s+")[0])
    marked = lines.select("line_no", text.alias("text"), named.alias("named"), text.startswith(bucket_prefix).cast("long").alias("is_file"))
    rows = running(marked.filter("named is not null or is_file = 1"), ["line_no"], {"file_idx": "is_file"}, {"source": "named"}).filter("is_file = 1")
    return rows.select(F.col("file_idx").cast("long").alias("file_idx"), F.coalesce("source", F.lit("unknown")).alias("source"), F.regexp_replace("text", "^" + bucket_prefix, url_prefix).alias("url"))


def with_global_index(rows: DataFrame, file_col: str, within_col: str, out: str = "global_seq", counts: DataFrame | None = None) -> DataFrame:
    """Number rows by file and place within it, in file order.

    Only the files' counts (``counts``: __file, n, if they are known) are summed in order, by sorted blocks; each row adds its file's offset.
    """
    counts = counts if counts is not None else rows.groupBy(F.col(file_col).alias("__file")).agg((F.max(within_col) + 1).alias("n"))
    offsets = running(counts, ["__file"], {"__offset": "n"}).select("__file", "__offset")
    return rows.join(offsets, rows[file_col] == offsets["__file"]).withColumn(out, F.col("__offset") + F.col(within_col)).drop("__file", "__offset")


def pack_fixed(files: DataFrame, length: int, max_tokens: int | None = None, file_col: str = "file_idx", tokens_col: str = "tokens") -> DataFrame:
    """Cut each file's tokens into rows of ``length``; tails are dropped and files never joined.

    Returns file_col, seq_in_file, global_seq, tokens; at most max_tokens // length rows, in file order.
    """
    n = F.floor(F.size(tokens_col) / length).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col(tokens_col), k * length + 1, F.lit(length)))
    rows = files.filter(n > 0).select(file_col, F.posexplode(cut).alias("seq_in_file", "tokens"))
    rows = with_global_index(rows, file_col, "seq_in_file", counts=files.groupBy(F.col(file_col).alias("__file")).agg(F.max(n).alias("n")))
    return rows if max_tokens is None else rows.filter(F.col("global_seq") < max_tokens // length)


def shard_place(seq: Column, shard_size: int) -> tuple[Column, Column]:
    return F.floor(seq / shard_size).cast("long").alias("shard_id"), (seq % shard_size).cast("long").alias("row_in_shard")


def shard_sizes(n: int, shard_size: int) -> list[int]:
    """Rows that each shard must have."""
    return [min(shard_size, n - at) for at in range(0, n, shard_size)]


#: Places that a task hands on at once.
_CHUNK = 1 << 20


def permutation(spark, n: int, seed: int) -> DataFrame:
    """(src_pos, out_pos) of the seeded order: the k-th row out is row shuffle[k] of PCG64 over 0 .. n-1.

    The generator is sequential, so one task draws the order whole (4 bytes a row below 2^32 rows) and hands it on in chunks, past the
    driver; for corpora too large for that there is :func:`keyed_place`.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            order = np.arange(n, dtype=np.uint32 if n < 1 << 32 else np.uint64)
            np.random.Generator(np.random.PCG64(seed)).shuffle(order)
            for at in range(0, n, _CHUNK):
                part = order[at : at + _CHUNK].astype(np.int64)
                yield pd.DataFrame({"src_pos": part, "out_pos": np.arange(at, at + len(part), dtype=np.int64)})

    # As in epoch_order: no broadcast of what only looks small.
    return spark.range(1, numPartitions=1).mapInPandas(draw, "src_pos long, out_pos long").hint("merge")


def shuffle_globally(rows: DataFrame, n: int, seed: int, shard_size: int, seq_col: str = "global_seq", order: DataFrame | None = None) -> DataFrame:
    """``rows`` with their place in the seeded order (or ``order``: src_pos, out_pos) as out_pos, shard_id and row_in_shard; :func:`bake` sorts and writes them."""
    order = permutation(rows.sparkSession, n, seed) if order is None else order
    shard, row = shard_place(F.col("out_pos"), shard_size)
    return rows.join(order, rows[seq_col] == order["src_pos"]).drop("src_pos").withColumns({"shard_id": shard, "row_in_shard": row})


#: Shards that one job writes, and rows that one of its tasks takes, if shards are smaller.
_JOB_SHARDS, _TASK_ROWS = 4096, 1 << 16


def bake(placed: DataFrame, folder: str, n: int, shard_size: int, shards_per_batch: int = 4096) -> DataFrame:
    """Write rows of :func:`shuffle_globally` as one sorted file a shard; returns them read back, in which a file's rows stand in their order.

    Each row goes straight to its shard's task, which sorts it.  A batch of shards is checked (each place filled once) and then
    committed by a marker beside the files; a restart passes over batches that have one and writes the others anew.  A job writes
    as many batches as make up 4096 shards; if it takes several jobs, the rows are first dealt by job, so that each reads only its own.
    """
    spark, shards, kind = placed.sparkSession, -(-n // shard_size), placed.schema
    per_job = max(1, _JOB_SHARDS // shards_per_batch) * shards_per_batch
    there = set(names_in(spark, folder))
    marker = {first: f"_batch_{first:07d}_{min(shards_per_batch, shards - first)}_COMPLETE" for first in range(0, shards, shards_per_batch)}
    jobs: dict[int, list[int]] = {}
    for first in marker:
        if marker[first] not in there:
            jobs.setdefault(first // per_job, []).append(first)
    batch = (F.floor(F.col("shard_id") / shards_per_batch) * shards_per_batch).cast("long")
    if len(jobs) > 1:
        job = F.floor(F.col("shard_id") / per_job).cast("long")
        path = shared_path(spark, "placed")
        dealt = placed.withColumn("__job", job).filter(F.col("__job").isin(*jobs))
        dealt.repartition("__job", F.col("shard_id") % 64).write.partitionBy("__job").parquet(path)
        placed = spark.read.schema(kind.add("__job", "long")).parquet(path)
    for k, batches in jobs.items():
        first, count = k * per_job, min(per_job, shards - k * per_job)
        own = placed.filter(F.col("__job") == k).drop("__job") if len(jobs) > 1 else placed
        own = own.withColumn("batch", batch).filter(F.col("batch").isin(*batches))
        per_task = max(1, min(_TASK_ROWS // shard_size, count // spark.sparkContext.defaultParallelism))
        own = own.withColumn("__to", F.floor((F.col("shard_id") - first) / per_task).cast("int")).repartitionById(-(-count // per_task), F.col("__to")).drop("__to")
        for b in batches:
            if f"batch={b}" in there:
                delete(spark, f"{folder}/batch={b}")
        own.sortWithinPartitions("batch", "shard_id", "row_in_shard").write.mode("append").partitionBy("batch", "shard_id").parquet(folder)
        paths = [f"{folder}/batch={b}" for b in batches if exists(spark, f"{folder}/batch={b}")]
        rows = spark.read.schema(kind).option("basePath", folder).parquet(*paths) if paths else own
        bad = underfilled(rows, n, shard_size, first, count).withColumn("batch", batch).filter(F.col("batch").isin(*batches))
        bad = {r.batch: r.worst for r in bad.groupBy("batch").agg(F.min(F.struct("shard_id", "filled", "expected")).alias("worst")).collect()}
        for b in batches:
            if b not in bad:
                put_text(spark, f"{folder}/{marker[b]}", "")
        if bad:
            _raise_unfilled(bad[min(bad)])
    out = spark.read.schema(kind.add("batch", "long")).option("basePath", folder).parquet(folder)
    return out.drop("batch")


def epoch_order(spark, n: int, batch: int, steps: int, seed: int) -> DataFrame:
    """(step, slot, row_id): one generator over all epochs; a tail shorter than a batch is passed over.

    One task draws an epoch's order after the other (8 bytes a row) and hands on its batches; nothing passes the driver.
    """
    if n < batch:
        raise ValueError(f"{n} rows are fewer than a batch of {batch}")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rng, per_epoch = np.random.default_rng(seed), n // batch
            for first in range(0, steps, per_epoch):
                order = rng.permutation(n)[: min(per_epoch, steps - first) * batch]
                for at in range(0, len(order), _CHUNK):
                    part = order[at : at + _CHUNK]
                    place = np.arange(at, at + len(part))
                    yield pd.DataFrame({"step": first + place // batch, "slot": (place % batch).astype(np.int32), "row_id": part})

    # Spark takes what one task draws for a small table; without the hint a join would broadcast it through the driver.
    return spark.range(1, numPartitions=1).mapInPandas(draw, "step long, slot int, row_id long").hint("merge")


def repeats_too_much(tokens: Column, max_period: int = 13, min_period: int = 1, max_count: int = 32) -> Column:
    """Whether some period p has a run of (max_count - 1) * p tokens that equal the token p before.

    Periods longer than a third of the sequence do not count; a sequence with -1 is kept.
    """
    n = F.size(tokens)

    def longest(p: int) -> Column:
        same = F.zip_with(F.slice(tokens, 1, F.greatest(n - p, F.lit(0))), F.slice(tokens, p + 1, F.greatest(n - p, F.lit(0))), lambda a, b: a == b)
        zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
        step = lambda s, x: F.struct(F.when(x, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["most"], F.when(x, s["run"] + 1).otherwise(0)).alias("most"))
        return F.aggregate(same, zero, step, lambda s: s["most"])

    bad = F.lit(False)
    for p in range(min_period, max_period + 1):
        bad = bad | F.when(n >= 3 * p, longest(p) >= (max_count - 1) * p).otherwise(F.lit(False))
    return ~F.array_contains(tokens, -1) & bad


def batches(rows: DataFrame, n: int, batch: int, seq_col: str = "global_seq") -> DataFrame:
    """Add batch_id and pos_in_batch; the last batch goes if it is not full."""
    at = F.col(seq_col)
    out = rows.withColumns({"batch_id": F.floor(at / batch).cast("long"), "pos_in_batch": (at % batch).cast("int")})
    return out.filter(F.col("batch_id") < n // batch)


def resume_row(valid: DataFrame, consumed: int, seq_col: str = "global_seq") -> DataFrame:
    """Row after the ``consumed``-th valid one, by order: only counts of blocks are summed in order."""
    block = F.floor(F.col(seq_col) / 10_000)
    rows = valid.withColumn("__block", block)
    own = running(rows.groupBy(F.col("__block").alias("part")).count(), ["part"], {"__before": "count"}).withColumnRenamed("part", "__block")
    own = own.filter((F.col("__before") < consumed) & (F.col("__before") + F.col("count") >= consumed))
    at = rows.join(F.broadcast(own), "__block").withColumn("__n", F.col("__before") + F.row_number().over(Window.partitionBy("__block").orderBy(seq_col)))
    return at.filter(F.col("__n") == consumed).select((F.col(seq_col) + 1).alias("resume_at"))


def micro_batches(rows: DataFrame, accumulate: int, batch: int) -> DataFrame:
    """Places of a step's rows in [accumulate, batch]: micro_batch and slot, from pos_in_batch."""
    at = F.col("pos_in_batch")
    return rows.withColumns({"micro_batch": F.floor(at / batch).cast("int"), "slot": (at % batch).cast("int")}).filter(F.col("micro_batch") < accumulate)


def remaining(total: int, shard_size: int, start_shard: int = 0, start_row: int = 0) -> int:
    """Rows from a start on, dropped ones counted."""
    return total - (start_shard * shard_size + start_row)


def cycled(rows: DataFrame, start: int, cycles: int, batch: int, seq_col: str = "global_seq") -> DataFrame:
    """Batches of several passes, each from the original start; every pass drops its last batch if that is not full.

    Adds cycle, batch_id (running over all passes) and pos_in_batch.
    """
    own = rows.filter(F.col(seq_col) >= start)
    bounds = own.agg(F.count("*").alias("n_rows"))
    out = own.join(F.broadcast(bounds)).withColumn("full", F.floor(F.col("n_rows") / batch))
    at = F.col(seq_col) - start
    out = out.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).filter(F.floor(at / batch) < F.col("full"))
    return out.withColumns({"batch_id": (F.col("cycle") * F.col("full") + F.floor(at / batch)).cast("long"), "pos_in_batch": (at % batch).cast("int")}).drop("n_rows", "full")


def max_steps(total_tokens: int, batch: int, accumulate: int, length: int) -> int:
    """Whole steps of a token budget."""
    return total_tokens // (batch * accumulate * length)


def epoch_steps(epochs: Column, n: Column, batch: int) -> Column:
    """Steps of so many epochs, the last one perhaps not full; one at least."""
    return F.greatest(F.ceil(epochs * n / batch), F.lit(1)).cast("long")


def running_tokens(steps: DataFrame, step_col: str, batch: int, length: int, start: int = 0) -> DataFrame:
    """Steps with total_tokens: what all steps up to theirs have read."""
    return steps.withColumn("total_tokens", (start + F.col(step_col) * batch * length).cast("long"))


def throughput(log: DataFrame, run_col: str, step_col: str, time_col: str, tokens_per_step: int) -> DataFrame:
    """Per logged step: steps, seconds and tokens a second since the run's last log; null for the first."""
    w = Window.partitionBy(run_col).orderBy(step_col)
    seconds = F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6
    out = log.withColumns({"steps": F.col(step_col) - F.lag(step_col).over(w), "seconds": seconds - F.lag(seconds).over(w)})
    return out.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("steps") * tokens_per_step / F.col("seconds")))


def underfilled(rows: DataFrame, n: int, shard_size: int, first: int = 0, count: int | None = None) -> DataFrame:
    """Shards (of ``count`` from ``first`` on) whose rows are not exactly those that n rows give: shard_id, filled, expected; none if the shuffle is whole."""
    shards = -(-n // shard_size) if count is None else first + count
    want = rows.sparkSession.range(first, shards).select(F.col("id").alias("shard_id"), F.least(F.lit(shard_size), F.lit(n) - F.col("id") * shard_size).alias("expected"))
    have = rows.groupBy("shard_id").agg(F.countDistinct("row_in_shard").alias("distinct_rows"), F.count("*").alias("filled"))
    out = want.join(have, "shard_id", "full").fillna(0, ["expected", "filled", "distinct_rows"])
    return out.filter((F.col("filled") != F.col("expected")) | (F.col("distinct_rows") != F.col("expected"))).select("shard_id", "filled", "expected")


def check_whole(rows: DataFrame, n: int, shard_size: int, first: int = 0, count: int | None = None) -> DataFrame:
    """``rows``; raises, naming a shard, if one is not filled exactly."""
    bad = underfilled(rows, n, shard_size, first, count).orderBy("shard_id").first()
    if bad:
        _raise_unfilled(bad)
    return rows


def _raise_unfilled(shard) -> None:
    raise ValueError(f"shard {shard.shard_id} has {shard.filled} of {shard.expected} rows")


def periodic_runs(rows: DataFrame, id_col: str, tokens_col: str = "tokens", max_period: int = 13, min_period: int = 1) -> DataFrame:
    """id_col, start, end, period, times: the longest runs in which every token equals the one a period before, of three whole periods or more.

    Each period up to a third of the sequence is compared in one pass over its tokens; a sequence that holds -1 has none, nulls have none.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for i, tokens in enumerate(batch.column("tokens")):
                x = np.asarray(tokens.values) if tokens.is_valid else np.zeros(0, np.int64)
                if (x == -1).any():
                    continue
                for p in range(min_period, min(max_period, len(x) // 3) + 1):
                    same = np.concatenate([[False], x[p:] == x[:-p], [False]])
                    edge = np.flatnonzero(same[1:] != same[:-1])
                    first, last = edge[::2], edge[1::2]
                    for a, b in zip(first[last - first >= 2 * p].tolist(), last[last - first >= 2 * p].tolist(), strict=True):
                        found.append((i, a, b + p, p, (b + p - a) // p))
            columns = list(zip(*found, strict=True)) or [()] * 5
            ids = batch.column("id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in columns[1:])], ["id", "start", "end", "period", "times"])

    own = rows.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("array<long>").alias("tokens"))
    return own.mapInArrow(run, f"id {kind}, start int, end int, period int, times int").withColumnRenamed("id", id_col)


def source_places(order: DataFrame, shard_size: int) -> DataFrame:
    """Where each source row lands: src_pos, out_pos, out_shard, out_row."""
    return order.select("src_pos", "out_pos", F.floor(F.col("out_pos") / shard_size).alias("out_shard"), (F.col("out_pos") % shard_size).alias("out_row"))


def keyed_place(seq: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """A place in 0 .. n-1 for each row, without a table: a Feistel network over the next power of four, walked until it falls inside.

    A bijection that every task computes alone, for corpora too large to draw a permutation on the driver; its order
    is not the generator's.
    """
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for r in range(rounds):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    def walk(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(64))
        return F.aggregate(steps, once(x), lambda at, _: F.when(at < n, at).otherwise(once(at)))

    place = walk(seq.cast("long"))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("no place was found")).cast("long"))


#: Strings that a shuffled corpus's manifest must hold.
_ALGORITHM, _FILE_ORDER = "numpy.random.PCG64.shuffle(np.arange(total_sequences, dtype=uint32))", "PCG64(seed).shuffle of source file-order"


def shuffled_manifest(manifest: dict, seed: int, source: str) -> dict:
    """The manifest of a shuffled corpus: the source's fields without those that no longer hold, and how it was shuffled."""
    kept = {k: v for k, v in manifest.items() if k not in ("file_shuffle_seed", "file_order", "packing")}
    return kept | {"globally_preshuffled": True, "shuffle_seed": seed, "shuffle_algorithm": _ALGORITHM, "shuffled_from": source, "file_order": _FILE_ORDER}


def check_unshuffled(manifest: dict) -> dict:
    """The manifest if its rows are still in file order; otherwise an error."""
    if "none at repack" not in manifest.get("shuffle_policy", ""):
        raise ValueError(f"the corpus is not in file order: {manifest.get('shuffle_policy')!r}")
    return manifest


def decayed(shape: Column, vocabulary: int) -> Column:
    """Whether a parameter decays: all do whose first dimension is not the vocabulary's."""
    return F.element_at(shape, 1) != vocabulary
