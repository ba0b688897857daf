"""Searches over vectors: multiprobe p-stable hashing, and an exact bit-sliced index."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut

# ---------------------------------------------------------------- approximate nearest neighbours

#: Hash functions a table, tables, cell width as a multiple of the usual neighbour distance.
FUNCTIONS, TABLES, WIDTH = 7, 2, 2.3
#: A query's probes of a table go on, likeliest bucket first, until this estimated chance that a neighbour is in one of them.
CHANCE = 0.75
#: Vectors of the sample that the distance is taken from, and the queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 256
#: Rows that one group takes, of one bucket or of several, and queries: larger buckets are split, and so are a group's queries.
BUCKET_ROWS, GROUP_QUERIES = 20_000, 20_000


def _finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def _blobs(df: DataFrame, kind: str) -> DataFrame:
    """The array column ``vec`` as bytes of numbers of a kind, without negative zeros."""
    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("vec")
            rows = [(np.asarray(x, kind) + np.dtype(kind).type(0)).tobytes() for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "vec", pa.array(rows, pa.binary()))

    return df.mapInArrow(run, kinds)


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (a five-term rational approximation, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


class PStable:
    """Tables of p-stable hashes for vectors of ``dim`` components with neighbours at about ``distance``."""

    def __init__(self, dim: int, distance: float, functions: int = FUNCTIONS, tables: int = TABLES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.distance, self.functions, self.tables = WIDTH * distance, distance, functions, tables
        self.directions = rng.standard_normal((tables, dim, functions))
        self.shifts = rng.random((tables, functions)) * self.width
        self.mixers = rng.integers(1, 1 << 62, functions) | 1
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=functions)))

    def cells(self, table: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions[table] + self.shifts[table]) / self.width

    def codes(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.clip(cells, -(1 << 40), 1 << 40).astype(np.int64) * self.mixers).sum(-1)

    def probes(self, table: int, x: np.ndarray, chance: float) -> np.ndarray:
        """Bucket codes for one query, by falling estimated chance of success, until they add up to ``chance``."""
        at = self.cells(table, x[None])[0]
        own = np.floor(at)
        steps = np.array([-1, 0, 1])[:, None]
        inside = _phi((own + steps + 1 - at) * self.width / self.distance) - _phi((own + steps - at) * self.width / self.distance)
        success = np.prod(inside[self.moves + 1, np.arange(self.functions)], axis=1)
        order = np.argsort(-success, kind="stable")
        n = int(np.searchsorted(np.cumsum(success[order]), chance)) + 1
        return self.codes(own + self.moves[order[:n]])


def usual_distance(sample: np.ndarray, k: int = 10) -> float:
    """Median distance of the k-th neighbour within the sample; 1 if there is none."""
    if len(sample) < 2:
        return 1.0
    found = []
    for q in sample[:SAMPLE_QUERIES]:
        d = np.sort(np.sqrt(((sample - q) ** 2).sum(1)))
        found.append(d[min(k, len(d) - 1)])
    return float(np.median(found)) or float(np.mean(found)) or 1.0


def _nearest(k: int, kind: str) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of each query the k nearest rows of a group among those in the buckets it asks for, ties to the smaller key."""

    def run(key: tuple, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(base) and len(asked):
            dims = base["vec"].str.len()
            for dim in dims.unique():
                rows = base[dims == dim].sort_values("code")
                x = np.stack([np.frombuffer(v, kind) for v in rows["vec"]]).astype(np.float64)
                code, keys, ids = rows["code"].to_numpy(), rows["vkey"].to_numpy(), rows["ids"].to_numpy()
                for qkey, vec, codes in zip(asked["qkey"], asked["qvec"], asked["codes"], strict=True):
                    if len(vec) == dim:
                        ends = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
                        own = np.concatenate([np.arange(a, b) for a, b in zip(*ends, strict=True)])
                        d = np.sqrt(((x[own] - np.frombuffer(vec, kind).astype(np.float64)) ** 2).sum(1))
                        last = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                        near = np.flatnonzero(d <= last)
                        near = near[np.lexsort((keys[own[near]], d[near]))][:k]
                        out.extend((qkey, keys[own[i]], d[i], ids[own[i]]) for i in near)
        return pd.DataFrame(out, columns=["qkey", "vkey", "score", "ids"])

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", chance: float = CHANCE) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Equal vectors are one candidate with its k + 1 smallest ids, so that a vector held by
    a third of all rows costs one; they are known by 128-bit digests.  Buckets share groups of bounded size, and large ones are
    split; a group gets each query once, with the buckets it asks for, and only the nearest k + 1
    leave it, with exact distances.  Probes travel without vectors until their bucket is known to
    exist.  A query for which fewer than k others turn up is compared with all
    vectors, in blocks.  Null, zero and non-finite vectors, and null ids, take no part; rows
    repeated with the same id and vector count once; vectors of other lengths are not compared.
    Vectors travel as they are stored, in single precision if that is their type; distances are in double precision.
    """
    spark, keep = vectors.sparkSession, k + 1
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    vec = vectors[vec_col].cast("array<float>" if kind == "<f4" else "array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & _finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    rows = cut(_blobs(rows, kind).withColumn("name", F.unhex(F.md5("vec"))), "ann-vectors")
    first = Window.partitionBy("name").orderBy("id")
    few = rows.select("id", "name").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep)
    heads = few.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vkey", F.col("ids")[0])
    classes = cut(rows.groupBy("name").agg(F.first("vec").alias("vec")).join(heads, "name"), "ann-classes")
    asked = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "name", "vec").dropDuplicates(["query_id", "name"])
    asked = cut(asked.join(classes.select("name", F.col("vkey").alias("qkey")), "name").select("query_id", "qkey", "vec"), "ann-queries")
    wanted = asked.groupBy("qkey").agg(F.first("vec").alias("qvec"))
    sample = [np.frombuffer(r.vec, kind).astype(np.float64) for r in classes.select("vkey", "vec").orderBy(F.xxhash64("vkey"), "vkey").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
    index = PStable(dim, usual_distance(np.stack([x for x in sample if len(x) == dim])))
    size = dim * np.dtype(kind).itemsize

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch.filter(pa.array([len(v) == size for v in batch.column("vec").to_pylist()], pa.bool_()))
            if fit.num_rows:
                x = np.stack([np.frombuffer(v, kind) for v in fit.column("vec").to_pylist()]).astype(np.float64)
                for t in range(index.tables):
                    code = index.codes(np.floor(index.cells(t, x)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), *(fit.column(c) for c in ("vkey", "vec", "ids"))], ["t", "code", "vkey", "vec", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qkey, vec in zip(batch.column("qkey"), batch.column("qvec"), strict=True):
                x = np.frombuffer(vec.as_py(), kind).astype(np.float64)
                for t in range(index.tables) if len(x) == dim else ():
                    code = np.unique(index.probes(t, x, chance))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(code), pa.array([qkey.as_py()] * len(code), pa.int64())], ["t", "code", "qkey"])

    def meet(base: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows (code, vkey, vec, ids) and queries (qkey, qvec, codes) of the same group: t, at, part."""
        key = ["t", "at", "part"]
        loads = cut(asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("turns")).filter("turns > 1"), "ann-loads")
        split = F.coalesce("turns", F.lit(1))
        asked = asked.join(loads, key, "left").withColumn("turn", F.pmod(F.xxhash64("qkey"), split).cast("int")).drop("turns")
        base = base.join(loads, key, "left").withColumn("turn", F.explode(F.sequence(F.lit(0), split - 1))).drop("turns")
        key = [*key, "turn"]
        return base.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_nearest(keep, kind), "qkey long, vkey long, score double, ids array<long>")

    base = cut(classes.select("vkey", "vec", "ids").mapInArrow(post, "t int, code long, vkey long, vec binary, ids array<long>"), "ann-postings")
    total = classes.count()
    buckets = cut(base.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("split")), "ann-buckets")
    groups = max(1, math.ceil(2 * total / BUCKET_ROWS))
    shared = F.pmod(F.xxhash64("code"), F.lit(groups))
    base = base.join(buckets.filter("split > 1"), ["t", "code"], "left")
    base = base.withColumns({"at": F.when(F.col("split") > 1, F.col("code")).otherwise(shared), "part": F.when(F.col("split") > 1, 1 + F.pmod(F.xxhash64("vkey"), F.col("split")).cast("int")).otherwise(0)}).drop("split")
    probes = wanted.mapInArrow(probe, "t int, code long, qkey long").join(buckets, ["t", "code"])
    parts = F.when(F.col("split") > 1, F.sequence(F.lit(1), F.col("split"))).otherwise(F.array(F.lit(0)))
    probes = probes.select("t", F.when(F.col("split") > 1, F.col("code")).otherwise(shared).alias("at"), F.explode(parts).alias("part"), "qkey", "code")
    probes = cut(probes.groupBy("t", "at", "part", "qkey").agg(F.collect_list("code").alias("codes")), "ann-probes")
    found = cut(meet(base, probes.join(wanted, "qkey")).dropDuplicates(["qkey", "vkey"]), "ann-found")

    def ranked(found: DataFrame) -> DataFrame:
        own = Window.partitionBy("qkey").orderBy("score", "vkey")
        best = found.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= keep)
        each = best.select("qkey", "score", F.explode("ids").alias("vec_id"))
        best = each.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy("score", "vec_id"))).filter(F.col("n") <= keep)
        return best.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))

    best = ranked(found)
    short = wanted.join(best.filter(F.size("best") >= keep).select("qkey"), "qkey", "left_anti")
    blocks, none = max(1, math.ceil(total / BUCKET_ROWS)), F.lit(0).cast("long")
    whole = meet(
        classes.select("vkey", "vec", "ids").withColumns({"t": F.lit(-1), "at": F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("long"), "part": F.lit(0), "code": none}),
        short.withColumns({"t": F.lit(-1), "at": F.explode(F.sequence(none, F.lit(blocks - 1).cast("long"))), "part": F.lit(0), "codes": F.array(none)}),
    )
    best = ranked(found.join(short, "qkey", "left_anti").unionByName(whole))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", "qkey").distinct().join(best, "qkey").select("query_id", F.posexplode(others).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))


# ---------------------------------------------------------------- exact top k by inner product

#: Rows of an index block, queries of a query block, and bytes of queries that all blocks are asked at once.
BLOCK_ROWS, BLOCK_QUERIES, QUERY_BYTES = 32_768, 64, 16 << 20


def _add_up(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Add bitmaps of equal weight with carry-save adders: one bitmap for each binary place of the sums."""
    out, place = [], 0
    while place <= max(columns, default=-1):
        row = columns.get(place, [])
        above = columns.setdefault(place + 1, []) if len(row) > 1 else None
        while len(row) > 2:
            a, b, c = row.pop(), row.pop(), row.pop()
            half = a ^ b
            row.append(half ^ c)
            above.append(a & b | half & c)
        if len(row) == 2:
            a, b = row
            above.append(a & b)
            row[:] = [a ^ b]
        out.append(row[0] if row else None)
        place += 1
    return out


class BitSliced:
    """One block of rows, by rising id: for each attribute the binary places of its distance from the block's least and most value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.low, self.high = self.x.min(0), self.x.max(0)
        self.all = self._pack(np.ones(len(ids), bool))
        self.up = [self._slices(self.x[:, i] - self.low[i]) for i in range(x.shape[1])]
        self.down = [self._slices(self.high[i] - self.x[:, i]) for i in range(x.shape[1])]

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view(np.uint64)

    def _slices(self, values: np.ndarray) -> list[np.ndarray]:
        return [self._pack((values >> b & 1).astype(bool)) for b in range(int(values.max()).bit_length())]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k largest inner products without the query's own rows, ties to the smaller id."""
        columns: dict[int, list[np.ndarray]] = {}
        for i, weight in enumerate(q.tolist()):
            slices, weight = (self.up[i], weight) if weight >= 0 else (self.down[i], -weight)
            for shift in range(weight.bit_length()):
                if weight >> shift & 1:
                    for b, bitmap in enumerate(slices):
                        columns.setdefault(b + shift, []).append(bitmap)
        maybe = self.all.copy()
        first, last = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right")
        for own in range(first, last):
            maybe[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sure = np.zeros_like(maybe)
        for bitmap in reversed(_add_up(columns)):
            if bitmap is None:
                continue
            with_one = sure | maybe & bitmap
            n = int(np.bitwise_count(with_one).sum())
            if n > k:
                maybe = maybe & bitmap
            else:
                sure, maybe = with_one, maybe & ~bitmap
                if n == k:
                    maybe = np.zeros_like(maybe)
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(maybe)[: k - len(rows)]])
        return [(int(self.ids[r]), int(self.x[r] @ q)) for r in rows]


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int, every: int | None) -> DataFrame:
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & _finite(F.col("vec")))
    if every:
        rows = rows.filter(F.col("id") % every == 0)
    size = BLOCK_QUERIES if every else BLOCK_ROWS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list[tuple]] = {}

        def block(rows: list[tuple]) -> pa.RecordBatch:
            ids, x = np.array([r[0] for r in rows], "<i8"), np.stack([r[1] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([int(ids.min())], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["dim", "least", "ids", "x"])

        for batch in batches:
            for id_, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = open_blocks.setdefault(len(vec), [])
                one.append((id_, np.floor(np.asarray(vec) * scale).astype(np.int64)))
                if len(one) == size:
                    yield block(open_blocks.pop(len(vec)))
        for one in open_blocks.values():
            yield block(one)

    return rows.mapInArrow(blocks, "dim int, least long, ids binary, x binary")


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of floor(scale * x) for rows whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Rows are dealt evenly in blocks, by number.  The stated queries come by broadcast, QUERY_BYTES at a time, and
    each block answers them by its bitmaps, in slices where there are fewer blocks than cores; k rows a query leave a block.  The driver keeps 8 bytes a block,
    one batch of queries and what Spark hands it at a time, a part of the queries' table.  Ties go to the smaller id.
    Vectors that are null or hold null or non-finite components, and null ids, take no part;
    zero vectors do.  Vectors of other lengths are not compared.  Products must fit 64 bits.
    Repeated rows are rows of their own, as in TOPK_SQL: each copy takes a rank, and each copy of a query meets every row.
    """
    spark = vectors.sparkSession
    rows = cut(_quantised(vectors, id_col, vec_col, scale, None).withColumn("uid", F.monotonically_increasing_id()), "sliced-rows")
    asked = cut(_quantised(vectors, id_col, vec_col, scale, every), "sliced-queries").withColumn("size", F.octet_length("x"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / BLOCK_ROWS))
    slices = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / groups))
    numbers = spark.createDataFrame(pd.DataFrame({"uid": [r.uid for r in rows.select("uid").orderBy("uid").collect()]}).reset_index(names="number").astype("int64"), "number long, uid long")
    dealt = rows.join(F.broadcast(numbers), "uid").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = dealt.withColumn("part", (F.col("number") % groups * slices + F.col("slice")).cast("int")).select("part", "slice", "dim", "ids", "x")
    dealt = dealt.repartitionById(groups * slices, F.col("part"))

    if asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] > QUERY_BYTES:
        dealt = cut(dealt, "sliced-dealt")  # every batch of queries reads it; dealt and written once

    def matched(queries: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple, list[tuple]]]:
            held: dict[tuple, list[tuple]] = {}
            now = None
            for batch in batches:
                for part, slice_, dim, ids, x in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "dim", "ids", "x")), strict=True):
                    if part != now and held:
                        yield held
                        held = {}
                    now = part
                    held.setdefault((part, slice_, dim), []).append((np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, dim)))
            yield held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, slice_, dim), blocks in (x for held in groups_of(batches) for x in held.items()):
                ids, x = (np.concatenate(c) for c in zip(*blocks, strict=True))
                for begin in range(0, len(ids), 2 * BLOCK_ROWS):
                    index, out = BitSliced(ids[begin : begin + 2 * BLOCK_ROWS], x[begin : begin + 2 * BLOCK_ROWS]), []
                    for qids, qx in queries.value:
                        if qx.shape[1] == dim:
                            for query, q in zip(qids[slice_::slices].tolist(), qx[slice_::slices], strict=True):
                                out.extend((query, row, score) for row, score in index.top(query, q, k))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        return run

    found, held, size = None, [], 0
    for r in chain(asked.toLocalIterator(), [None]):
        if held and (r is None or size + r.size > QUERY_BYTES):
            one = cut(dealt.mapInArrow(matched(spark.sparkContext.broadcast(held)), "query_id long, vec_id long, score long"), "sliced-found")
            found, held, size = one if found is None else found.unionByName(one), [], 0
        if r is not None:
            held.append((np.frombuffer(r.ids, "<i8"), np.frombuffer(r.x, "<i8").reshape(-1, r.dim)))
            size += r.size
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
