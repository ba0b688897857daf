"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, cut, few, from_planes, mix64, planes, release, released, unused

WORDS = 5
#: Similarity as a fraction, in whole numbers.
NUM, DEN = 4, 5
#: N-grams of a task counted at once; those it counts twice or more are handed on, at most so many, the most frequent.
COUNTED, HANDED_ON = 1_000_000, 50_000
#: N-grams known as frequent (a table of at most 9 bytes each); all others count as rare alike.
FREQUENT = 300_000
#: Prefix n-grams that one reducer group takes; an n-gram in so many prefixes' eighth is dealt to several groups.
BUCKET = 400_000
#: Postings a task holds before it hands them on.
HELD = 500_000
#: Rounds in which each set meets the nearest one of another component, before all that are left meet.
NEAREST = 1
#: Postings of an n-gram that meet in one block, postings of a group, and pairs held before they are filtered.
BLOCK, GROUP, PAIRS = 2_000, 100_000, 2_000_000
#: Bits of a signature: a power of two, SPREAD for each n-gram, between these.
SPREAD, LEAST_BITS, MOST_BITS = 4, 512, 32_768
#: N-grams of a set that are compared at once.
PART = 16_384
#: Odd multiplier of the n-gram hash.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of the whole sequence if it is shorter; none without words.

    Words are hashed as strings and their hashes combined in order, so no two n-grams share a hash but by the chance of 64 bits.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    m = len(words) - k + 1
    with np.errstate(over="ignore"):
        x = each[:m] + np.uint64(k)
        for j in range(1, k):
            x = (x ^ x >> np.uint64(32)) * _ODD + each[j : j + m]
    return np.unique(mix64(x))


def name_of(grams: np.ndarray) -> tuple[int, int]:
    """A 128-bit name for a set of n-grams, as two whole numbers; equal sets share it."""
    name = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (name >> 64) - (1 << 63), (name & (1 << 64) - 1) - (1 << 63)


def signature(grams: np.ndarray) -> bytes:
    """For each range of the hash space, whether the set has an odd number of n-grams in it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPREAD * len(grams) - 1).bit_length()))
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def folded(signatures: np.ndarray, size: int) -> np.ndarray:
    """Rows of signatures for ranges that are unions of the given ones, ``size`` bytes each."""
    while signatures.shape[1] > size:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """So many rarest n-grams of a set of n hold one of any set that is similar enough."""
    return n - -(-n * NUM // DEN) + 1


def most_apart(total: np.ndarray) -> np.ndarray:
    """Two similar sets of ``total`` n-grams together differ in so many at most."""
    return total - 2 * -(-total * NUM // (NUM + DEN))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: id, t1, t2, h1, h2, n; of kind 1: n-grams (h1) that the task counted n > 1 times."""
    held, waiting = [], 0
    seen: set[tuple[int, int]] = set()
    id_kind = pa.int64()
    names = ["kind", "id", "t1", "t2", "h1", "h2", "n"]

    def rows(kind: int, ids: pa.Array, t1, t2, h1, h2, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, t1, t2, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64())], names)

    def counted() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        some = np.flatnonzero(counts > 1)
        some = some[np.argsort(-counts[some], kind="stable")[:HANDED_ON]]
        none = pa.nulls(len(some), pa.int64())
        return rows(1, pa.nulls(len(some), id_kind), none, none, grams[some].view(np.int64), np.zeros(len(some), np.int64), counts[some])

    for batch in batches:
        id_kind, h1, h2, n = batch.column("id").type, [], [], []
        for text in batch.column("text"):
            grams = shingles(text.as_py())
            name = name_of(grams)
            h1.append(name[0])
            h2.append(name[1])
            n.append(len(grams))
            if name not in seen:
                seen.add(name)
                held.append(grams)
                waiting += len(grams)
                if waiting > COUNTED:
                    yield counted()
                    held, waiting = [], 0
        yield rows(0, batch.column("id"), batch.column("t1"), batch.column("t2"), h1, h2, n)
    if held:
        yield counted()


def _matches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Postings of the n-grams that several sets have in their prefixes and that may be the first common one of two of them, or that are dealt to several groups."""
    gram, node = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[c]]) for c in ("grams", "nodes"))
    size = np.concatenate([from_planes(x) for x in pdf["sizes"]]).view(np.uint64)
    order = np.lexsort((node, gram))
    gram, node, size = gram[order], node[order], size[order]
    first = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]))  # copies from several tasks count once
    gram, node, size = gram[first], node[first], size[first]
    n, at, split = (size >> np.uint64(32)).astype(np.int64), (size >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64), (size & np.uint64(1)).astype(bool)
    keep = np.arange(len(gram))
    for _ in range(2):  # what goes first may have been another's only partner
        keep = keep[_has_partner(gram[keep], n[keep], at[keep]) | split[keep]]
    out = pd.DataFrame({"gram": gram[keep], "node": node[keep], "n": n[keep], "at": at[keep].astype(np.int32)})
    release()
    return out


def _has_partner(gram: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether another set with the same n-gram (they are sorted) has a size that the length and positional filters let pass: from 0.8 n to the one of which too much is left."""
    run = np.cumsum(np.append(True, gram[1:] != gram[:-1])) << 32
    most = ((n - at) * (NUM + DEN) // NUM) - n
    sizes = np.sort(run + n)
    found = np.searchsorted(sizes, run + most, "right") - np.searchsorted(sizes, run + -(-n * NUM // DEN))
    return found > (n <= most)


def _possible(n: str, at: str, m: str, bt: str) -> Column:
    """Length filter, and positional filter for a first common n-gram at these places."""
    n, at, m, bt = map(F.col, (n, at, m, bt))
    need = F.ceil((n + m) * NUM / F.lit(NUM + DEN))
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (F.least(n - at, m - bt) >= need)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix filter: pairs whose signatures differ in no more ranges than similar sets have differences."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
            x, y = (np.frombuffer(z, np.uint8).reshape(1, -1) for z in (x, y))
            size = min(x.shape[1], y.shape[1])
            keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most_apart(n + m))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _met(nearest: bool):
    """Pairs of a group's sets that share an n-gram, lie in two components and pass all filters; of each set the nearest one only, if asked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n, root = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "root"))
        many = pdf["grams"].str.len().to_numpy()
        place = np.repeat(np.arange(len(pdf)), many)
        gram, at, i, j = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("grams", "ats", "is", "js"))
        own = np.concatenate([np.asarray(x) for x in pdf["own"]])
        order = np.lexsort((j, i, gram))
        place, gram, at, i, j, own = (x[order] for x in (place, gram, at, i, j, own))
        bounds = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        ends = np.append(bounds[1:], len(gram))
        widths = pdf["sig"].str.len().to_numpy()
        tables = {w: (np.cumsum(in_ := (widths == w) | (widths == 2 * w)) - 1, np.concatenate([folded(np.frombuffer(x, np.uint8).reshape(1, -1), w) for x in pdf["sig"][in_]])) for w in np.unique(widths)}
        found, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, n_waiting = [], 0

        def filtered() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.unique(np.concatenate(waiting))
            x, y = pairs // len(pdf), pairs % len(pdf)
            size, far = np.minimum(widths[x], widths[y]), np.empty(len(pairs), np.int64)
            for w, (row, table) in tables.items():
                some = np.flatnonzero(size == w)
                for part in np.array_split(some, max(1, len(some) * w >> 24)):
                    far[part] = np.bitwise_count(table[row[x[part]]] ^ table[row[y[part]]]).sum(1, dtype=np.int64)
            near = far <= most_apart(n[x] + n[y])
            pairs, far = np.concatenate([found, pairs[near]]), np.concatenate([distance, far[near]])
            pairs, once = np.unique(pairs, return_index=True)
            return pairs, far[once]

        for a, b in zip(bounds.tolist(), ends.tolist(), strict=True):
            p = place[a:b]
            size, left, group = n[p], n[p] - at[a:b], root[p]
            if b - a < 2 or (group == group[0]).all():
                continue
            need = -(-(size[:, None] + size[None, :]) * NUM // (NUM + DEN))
            fit = np.minimum(left[:, None], left[None, :]) >= need
            fit &= (group[:, None] < group[None, :]) & (np.minimum(size[:, None], size[None, :]) * DEN >= np.maximum(size[:, None], size[None, :]) * NUM)
            if i[a] != j[a]:
                fit &= own[a:b][:, None] != own[a:b][None, :]
            x, y = np.nonzero(fit)
            waiting.append(p[x] * len(pdf) + p[y])
            n_waiting += len(x)
            if n_waiting > PAIRS:
                found, distance = filtered()
                waiting, n_waiting = [], 0
        if waiting:
            found, distance = filtered()
        if nearest and len(found):
            ends_ = np.concatenate([found // len(pdf), found % len(pdf)])
            order = np.lexsort((np.tile(found, 2), np.tile(distance, 2), ends_))
            best = order[np.append(True, np.diff(ends_[order]) != 0)] % len(found)
            found = found[np.unique(best)]
        x, y = node[found // len(pdf)], node[found % len(pdf)]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def components(links: DataFrame, label: str, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b, a written table of different nodes); root is its component's least node.

    Alternates large-star and small-star steps; each writes its links, and the driver sees only counts.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.filter("v <= u")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    write = scratch.cut if scratch else cut
    edges, before = links, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = write(star(star(edges, True), False), f"{label}-stars")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(edges.select("b", "b").distinct())


def _parts(n: Column) -> Column:
    """Binary places of the number of parts in which a set of n is compared."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(PART))))).cast("int")


def _prefixes(held, shared: set[int], buckets: int):
    """Each set's rarest n-grams, rarest first, dealt to groups by n-gram; those of very frequent ones also by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, levels), seen, waiting, n_waiting = held.value, set(), [], 0

        def rarity(grams: np.ndarray) -> np.ndarray:
            out = np.zeros(len(grams), np.uint8)
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                same = known[at] == grams
                out[same] = levels[at[same]]
            return out

        def dealt() -> pa.RecordBatch:
            gram, bucket, node, size = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) + 1
            parts = [order[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            columns = [[int(bucket[p[0]]) for p in parts], [gram[p].tobytes() for p in parts], [node[p].tobytes() for p in parts], [planes(size[p].view(np.int64)) for p in parts]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "grams", "nodes", "sizes"])

        for batch in batches:
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                h1, h2 = name_of(grams)
                node = h2 if h1 in shared else h1
                if not len(grams) or node in seen:
                    continue
                seen.add(node)
                m = int(prefix_length(len(grams)))
                level = rarity(grams)
                first = np.argsort(level, kind="stable")[:m]  # the hashes rise, so ties go by hash
                chosen = grams[first]
                split = np.ceil(np.exp2(level[first] / 2) / (BUCKET / 8)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    spread = np.uint64(node + (1 << 63)) % np.maximum(split, 1)
                    bucket = ((chosen + spread * _ODD) % np.uint64(buckets)).astype(np.int32)
                size = (np.uint64(len(grams)) << np.uint64(32)) + (np.arange(m, dtype=np.uint64) << np.uint64(1)) + (split > 1)
                waiting.append((chosen, bucket, np.full(m, node, np.int64), size.astype(np.uint64)))
                n_waiting += m
                if n_waiting > HELD:
                    yield dealt()
                    waiting, n_waiting = [], 0
        if waiting:
            yield dealt()

    return run


def _fetched(rows: DataFrame, nodes: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of each node's n-grams, from the texts of the nodes' least ids; the text's own name decides."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for text, node, h1, h2 in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("node", "h1", "h2")), strict=True):
                if node not in done and name_of(grams := shingles(text.as_py())) == (h1, h2):
                    done.add(node)
                    out = list(zip(*make(node, grams), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split(" ")[1]] for x in schema.split(", ")]
    known = few(nodes.select(F.col("least").alias("id"), "node", "h1", "h2"), "id")
    same = rows["id"].eqNullSafe(known["id"]) if nodes.filter("least is null").limit(1).count() else rows["id"] == known["id"]
    return rows.join(known, same).select("text", "node", "h1", "h2").mapInArrow(released(run), schema).hint("rebalance")


def _sets(part: int):
    """A set in parts by its upper hash bits, for the numbers of parts that sets of like size may ask for."""

    def make(node: int, grams: np.ndarray) -> list[tuple]:
        out = []
        for p in sorted({max(0, int(np.ceil(np.log2(max(1.0, x) / part)))) for x in (len(grams), len(grams) * DEN // NUM)}):
            bounds = np.searchsorted(grams, np.arange(1, 1 << p, dtype=np.uint64) << np.uint64(64 - p)) if p else []
            out.extend((node, p, i, x.view(np.int64)) for i, x in enumerate(np.split(grams, bounds)))
        return out

    return make


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, t1, t2 (hashes of its text), n, component_id."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    survey = rows.select("id", "text", *text_names(F.col("text"))).mapInArrow(released(_survey), f"kind int, id {kind}, t1 long, t2 long, h1 long, h2 long, n long")
    scratch = Scratch(spark)
    survey = cut(survey.hint("rebalance"), "jaccard-survey")  # few files: a task has little to say
    every = survey.filter("kind = 0").drop("kind")
    nodes = scratch.cut(every.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("n").alias("n")), "jaccard-sets")
    # a set goes by the first half of its name, unless two sets share it: by chance, some three pairs of 10**10 sets
    shared = [r.h1 for r in nodes.groupBy("h1").count().filter("count > 1").select("h1").collect()]
    nodes = nodes.withColumn("node", F.when(F.col("h1").isin(*shared), F.col("h2")).otherwise(F.col("h1")) if shared else F.col("h1"))
    total = nodes.agg(F.coalesce(F.sum(F.expr(f"n - ceil(n * {NUM} / {DEN}) + 1")), F.lit(0))).first()[0]
    if not total:
        scratch.clear()
        return every.select("id", "t1", "t2", "n", F.col("id").alias("component_id"))
    heavy = survey.filter("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(FREQUENT).toArrow()
    frequent, n = heavy.column("h1").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(frequent)
    held = spark.sparkContext.broadcast((frequent[order], np.minimum(255, 2 * np.log2(np.maximum(n, 1)))[order].astype(np.uint8)))
    dealt = rows.select("text").mapInArrow(released(_prefixes(held, set(shared), max(1, -(-int(total) // BUCKET)))), "bucket int, grams binary, nodes binary, sizes binary")
    postings = scratch.cut(dealt.groupBy("bucket").applyInPandas(_matches, "gram long, node long, n long, at int"), "jaccard-matches")
    # an n-gram's pivot has the fewest rarer n-grams of its own: of near copies the one least changed
    pivots = postings.groupBy("gram").agg(F.min(F.struct("at", "node", "n")).alias("p")).select("gram", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"))
    postings = scratch.cut(postings.join(pivots, "gram"), "jaccard-postings")
    own = postings.select("node").distinct().join(nodes, "node")
    signatures = scratch.cut(_fetched(rows, scratch.cut(own, "jaccard-own"), lambda node, grams: [(node, len(grams), signature(grams))], "node long, n long, sig binary"), "jaccard-signatures")
    side = lambda x: signatures.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"x{x}"))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs whose whole sets are similar enough."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        own = scratch.cut(ends.join(nodes, "node"), f"{label}-ends")
        sets = scratch.cut(_fetched(rows, own, _sets(PART), "node long, p int, part int, grams array<long>"), f"{label}-sets")
        n_of = lambda x: few(own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")), x)
        sized = pairs.join(n_of("a"), "a").join(n_of("b"), "b").withColumn("p", _parts(F.greatest("na", "nb")))
        one = sets.select(F.col("node").alias("a"), "p", "part", F.col("grams").alias("ga"))
        other = sets.select(F.col("node").alias("b"), "p", "part", F.col("grams").alias("gb"))
        same = sized.join(one, ["a", "p"]).join(other, ["b", "p", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("same"))
        return same.groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same")).filter(F.col("same") * DEN >= (F.col("na") + F.col("nb") - F.col("same")) * NUM).select("a", "b")

    near = (F.col("node") != F.col("pivot")) & _possible("n", "at", "pn", "pat")
    stars = postings.filter(near).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    met = scratch.cut(stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_apart, "a long, b long"), "jaccard-met0")
    links, roots, left, tried = None, None, postings, met
    for round_ in range(1, NEAREST + 3):
        if met.limit(1).count():
            found = verified(met, f"jaccard-round{round_}")
            links = scratch.cut(found if links is None else links.union(found), f"jaccard-links{round_}")
            roots = scratch.cut(components(links, f"jaccard-{round_}", scratch), f"jaccard-roots{round_}")
        if round_ == NEAREST + 2:
            break
        named = left.select("gram", "node", "n", "at", "pivot")
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else named.withColumn("root", F.col("node"))
        split = named.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).filter("lo <> hi").select("gram", "blocks")
        left = scratch.cut(named.join(split, "gram"), f"jaccard-left{round_}")
        size = left.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
        if not size:
            break
        dealt = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        busy = left.groupBy("pivot").agg(F.ceil(F.sum("blocks") / F.lit(GROUP)).alias("shares")).filter("shares > 1")  # at most a row for GROUP postings
        dealt = dealt.join(F.broadcast(busy), "pivot", "left").withColumn("share", F.when(F.col("shares") > 1, F.pmod(F.xxhash64("gram", "i", "j"), F.col("shares"))).otherwise(F.lit(0)))
        dealt = dealt.withColumn("group", F.pmod(F.xxhash64("pivot", "share"), F.lit(max(1, int(size) // GROUP))))
        dealt = dealt.groupBy("group", "node", "n", "root").agg(*[F.collect_list(x).alias(y) for x, y in (("gram", "grams"), ("at", "ats"), ("i", "is"), ("j", "js"), ("own", "own"))])
        dealt = dealt.join(signatures.select("node", "sig"), "node")
        again = dealt.groupBy("group").applyInPandas(_met(round_ <= NEAREST), "a long, b long").distinct()
        met = scratch.cut(again.join(tried, ["a", "b"], "left_anti"), f"jaccard-met{round_}")
        tried = tried.union(met)
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("h1", "h2", "root", "least")
    named = cut(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h1", "h2", "root", "component_id"), "jaccard-components")
    scratch.clear()  # what follows reads the survey and the components only
    out = every.join(named, ["h1", "h2"], "left")
    return out.select("id", "t1", "t2", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def text_names(text: Column) -> list[Column]:
    """Two hashes of a text, 128 bits together."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by word n-gram similarity: id_col, n_shingles, component_id.

    Equal sets are one node.  Each node's rarest n-grams (its prefix, by the document
    frequencies of those that tasks find repeated, ties by hash) are dealt by n-gram, very frequent ones in several
    groups.  Where several nodes share one, each meets the n-gram's pivot, the node least changed.  Then those whose
    components still differ meet in groups by pivot, first each with the nearest of another component
    only, at last with all that pass: n-grams that very many nodes share are met in blocks.  Pairs pass the
    length, positional and suffix filters inside the group and are verified on their whole sets.  A group of near
    copies is linked through few pairs, and no link between components is lost.  Null and wordless texts have no n-grams
    and stay alone; repeated rows share a component; a null id takes no part in the least id; other columns are not read.
    """
    found = _classes(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`jaccard_components`, with all columns of ``docs``.

    It is the row of least id, ids that are null last, and of several rows with this id the one of least text hash; rows
    that repeat both id and text count as one, whichever.  Rows of one id with unlike texts are in two
    components and both stay.  Rows without words all stay.  Columns may have any names; an empty table stays empty.
    """
    words = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = _classes(docs, id_col, text_col).filter("n > 0")
    if "root" not in found.columns:
        return docs
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2")
    kept = found.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("n"))
    names = {x: unused(docs, f"kept_{x}") for x in ("id", "t1", "t2")}
    kept = cut(kept.select(*[F.col(f"k.{x}").alias(y) for x, y in names.items()]), "jaccard-kept")
    t1, t2 = (x for x in text_names(docs[text_col]))
    tagged = docs.filter(words).withColumns({unused(docs, "own_t1"): t1, unused(docs, "own_t2"): t2})
    a, b = tagged.columns[-2:]
    keys = few(kept, names["id"])
    out = tagged.join(keys, tagged[id_col].eqNullSafe(keys[names["id"]]) & (tagged[a] == keys[names["t1"]]) & (tagged[b] == keys[names["t2"]]), "left_semi")
    rows_of = found.groupBy("id", "t1", "t2").count().filter("count > 1").limit(1).count()
    out = out.dropDuplicates([id_col, a, b]) if rows_of else out
    return out.drop(a, b).unionByName(docs.filter(~words))


#: The same in DuckDB: every pair of documents that share an n-gram, and all that is reachable by links.
JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * same >= 80 * (len(x.sh) + len(y.sh) - same)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT b AS doc_id, root FROM reach JOIN both_ways ON a = reach.doc_id)
SELECT s.doc_id, any_value(len(sh)) AS n_shingles, min(root) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id"""
