"""Removal of repeated byte strings by difference-cover suffix sorting, distributed by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import STARTS, Scratch, few, from_planes, giving_back, joined_by, least_places, mix64, planes, prefix_hash, release, released, span_hash
from corvane.llm.common import cut as common_cut

#: Bytes of a string that counts as repeated, and of a passage: some fifty words.
LENGTH, PASSAGE = 400, 250
#: Bytes of the blocks whose hashes choose a string's anchor.
BLOCK = 100
#: Bytes of fragments that one suffix array is built over.
ARRAY_BYTES = 400_000
#: Fragments that a task holds before it deals them, and that one group takes.
HELD, GROUP = 200_000, 400_000
#: An anchor with more different fragments is split: strings by how far the anchor is into them, RANGE bytes at a time, and by the bytes that such strings
#: share; where more different pieces share these, into the strings themselves.
HOT, RANGE = 2_000, 32
#: Starts of a text whose anchors are found at once.
_STARTS = STARTS


# ---------------------------------------------------------------- difference cover


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their three columns, and each row's name: its rank among distinct rows, from 1."""
    if max(int(c.max()) for c in columns) < 1 << 21:
        columns = [columns[0] << 42 | columns[1] << 21 | columns[2]]
        order = np.argsort(columns[0])
    else:
        order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of whole numbers >= 1, by the difference cover {1, 2} modulo 3.

    Triples at positions 1 and 2 modulo 3 are sorted and named; where names repeat,
    their own suffix array ranks them.  Suffixes at 0 modulo 3 are sorted by first value and the
    next suffix's rank, and the two orders are merged.
    """
    n = len(text)
    if n < 8:
        values = text.tolist()
        return np.array(sorted(range(n), key=lambda i: values[i:]), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, names = _names([t[sample], t[sample + 1], t[sample + 2]])
    if names.max() < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * (n + 3) + rank[zeros + 1])]
    return _merged(t, rank, sampled, zeros)


def _merged(t: np.ndarray, rank: np.ndarray, sampled: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Merge two sorted suffix lists.

    Against a suffix at 1 modulo 3 one value decides and then the next suffixes' ranks; at 2 modulo 3
    two values and the ranks after them.  Each is one whole number, in the lists' own order.
    """
    base = len(rank) + 1
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    if (int(t.max()) + 1) ** 2 * base < 1 << 63:
        pair, size = t[:-1] * (int(t.max()) + 1) + t[1:], base
    else:
        pair = np.unique(np.stack([t[:-1], t[1:]], axis=1), axis=0, return_inverse=True)[1].ravel()
        size = base
    one = lambda i: t[i] * base + rank[i + 1]
    two = lambda i: pair[i] * size + rank[i + 2]
    low = np.searchsorted(one(ones), one(zeros)) + np.searchsorted(two(twos), two(zeros))
    out = np.empty(len(zeros) + len(sampled), np.int64)
    at = low + np.arange(len(zeros))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = zeros, sampled
    return out


def common_prefixes(data: np.ndarray, text: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours of the order, by their bytes; ``room``: bytes up to the fragment's end.

    Where a suffix and the one before it in the order follow equal values, their prefix is that of the place before, less one; only the
    others are compared, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    new = (at == 0) | (before <= 0) | (text[at - 1] != text[before - 1])
    eights = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    length = np.zeros(n, np.int64)
    a = np.flatnonzero(new & (before >= 0))
    b, most = before[a], np.minimum(room[a], room[before[a]])
    same = np.zeros(len(a), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        x, y = a[going] + same[going], b[going] + same[going]
        differ = np.ascontiguousarray(eights[x]) != np.ascontiguousarray(eights[y])
        same[going] += np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        going = going[~differ.any(axis=1) & (same[going] < most[going])]
    length[a] = np.minimum(same, most)
    last = np.maximum.accumulate(np.where(new, at, 0))
    return (length[last] - (at - last))[order[1:]]


def repeated_starts(fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment, the starts of strings of ``length`` bytes that also start at another place of the fragments."""
    sizes = np.array([len(x) + 1 for x in fragments])
    end = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x + b"\0" for x in fragments), np.uint8)
    text = data.astype(np.int64) + 1
    text[end - 1] = 257 + np.arange(len(fragments))  # ends are all different, so no order depends on what follows them
    order = suffix_array(text)
    room = np.repeat(end - 1, sizes) - np.arange(len(text))
    shared = common_prefixes(data, text, room, order) >= length
    flags = np.zeros(len(text), bool)
    flags[order[:-1][shared]] = flags[order[1:][shared]] = True
    return [np.flatnonzero(x) for x in np.split(flags, end[:-1])]


# ---------------------------------------------------------------- distribution by content


def anchors(data: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, count of starts, anchor's place in the fragment) of the text's fragments.

    The anchor of a string of ``length`` bytes is its block of least hash (its upper 40 bits), the
    last of equals.  Equal strings have equal anchors at equal places.  A fragment is
    the run of strings with one anchor.
    """
    found = []
    window = length - block + 1
    pre = prefix_hash(data)
    for begin in range(0, len(data) - length + 1, _STARTS):
        at = np.arange(begin, min(len(data) - block + 1, begin + _STARTS + window - 1))
        hashes = span_hash(pre, at, at + block)
        anchor = least_places(hashes, window)
        n = len(anchor)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, n))
        found.append((hashes[anchor[first]].view(np.int64), begin + first, count, anchor[first] - first))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")


_PLACE = ("g", "f", "c1", "c2", "first", "size")
#: Kinds of dealt fragments: alone with its anchor in the task's share; one for many there; one of many.
_ALONE, _ONE, _MANY = 0, 1, 2


def _fragments(length: int, groups: int):
    """Fragments dealt by anchor.  Of an anchor that a task meets twice, one is dealt so; the others, surely needed, are spread evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()
        waiting, n_waiting = [], 0

        def dealt() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            g = columns[0]
            first = np.append(True, g[1:] != g[:-1])
            many = np.repeat(np.diff(np.append(np.flatnonzero(first), len(g))) > 1, np.diff(np.append(np.flatnonzero(first), len(g))))
            one = np.flatnonzero(first & many)
            kind = np.concatenate([np.where(many, _MANY, _ALONE), np.full(len(one), _ONE)]).astype(np.uint8)
            columns = [np.concatenate([c, c[one]]) for c in columns]
            with np.errstate(over="ignore"):
                spread = mix64(columns[2].view(np.uint64) + columns[4].view(np.uint64))
            group = (np.where(kind == _MANY, spread, columns[0].view(np.uint64)) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(group[order]) != 0, True)) + 1
            parts = [order[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            arrays = [pa.array([int(group[p[0]]) for p in parts], pa.int32()), pa.array([kind[p].tobytes() for p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([planes(c[p]) for p in parts], pa.binary()) for c in columns)], ["group", "kind", *_PLACE])

        for batch in batches:
            for c1, c2, text in zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist(), batch.column("text"), strict=True):
                if (c1, c2) in done:
                    continue
                done.add((c1, c2))
                data = _bytes(text.as_py())
                g, first, count, at = anchors(np.frombuffer(data, np.uint8), length)
                names = [xxhash.xxh3_64_intdigest(data[a : a + n - 1 + length], seed=s) for a, n, s in zip(first.tolist(), count.tolist(), at.tolist(), strict=True)]
                waiting.append((g, np.array(names, np.uint64).view(np.int64), np.full(len(g), c1), np.full(len(g), c2), first, count << 32 | at))
                n_waiting += len(g)
                if n_waiting > HELD:
                    yield dealt()
                    waiting, n_waiting = [], 0
        if n_waiting:
            yield dealt()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fragments whose anchor stands at two places at least."""
    kind = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["kind"]])
    columns = [np.concatenate([from_planes(x) for x in pdf[c]]) for c in _PLACE]
    sure, rest = np.flatnonzero(kind == _MANY), np.flatnonzero(kind != _MANY)
    g, f, c1, c2, first, _ = (c[rest] for c in columns)
    order = np.lexsort((first, c2, c1, g))
    rest, g, c1, c2, first = rest[order], g[order], c1[order], c2[order], first[order]
    new = np.append(True, g[1:] != g[:-1])
    place = new | np.append(True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (first[1:] != first[:-1]))
    start = np.flatnonzero(new)
    several = (np.add.reduceat(place.astype(np.int64), start) > 1) | (np.maximum.reduceat((kind[rest] == _ONE).astype(np.int64), start) > 0) if len(g) else np.zeros(0, bool)
    keep = np.repeat(several, np.diff(np.append(start, len(g)))) & (kind[rest] == _ALONE)
    chosen = np.concatenate([sure, rest[keep]])
    out = {c: x[chosen] for c, x in zip(_PLACE, columns, strict=True)}
    size = out.pop("size")
    release()
    return pd.DataFrame(out | {"count": (size >> 32).astype(np.int32), "at": (size & 0xFFFFFFFF).astype(np.int32)})


def _cutouts(length: int):
    """Bytes of the asked fragments of each text; those of hot anchors in ranges, keyed by what the strings of a range share."""

    def split(data: bytes, x: dict) -> Iterator[tuple]:
        first, anchor = x["first"], x["first"] + x["at"]
        for r in range((x["at"] - x["count"] + 1) // RANGE, x["at"] // RANGE + 1):
            low, high = max(first, anchor - (r + 1) * RANGE + 1), min(first + x["count"] - 1, anchor - r * RANGE)
            core = data[anchor - r * RANGE : anchor - (r + 1) * RANGE + 1 + length]
            key = xxhash.xxh3_64_intdigest(core, seed=(x["g"] + r) & (1 << 64) - 1) - (1 << 63)
            piece = data[low : high + length]
            yield key, xxhash.xxh3_64_intdigest(piece, seed=(anchor - low) & 0xFFFF) - (1 << 63), x["g"], x["f"], low - first, piece, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.int32(), pa.binary(), pa.bool_()]
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                data, out = _bytes(text.as_py()), []
                for x in asked:
                    if x["hot"]:
                        out.extend(split(data, x))
                    else:
                        out.append((x["g"], x["f"], x["g"], x["f"], 0, data[x["first"] : x["first"] + x["count"] - 1 + length], False))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "content", "g", "f", "base", "data", "hot"])

    return run


def _strings(length: int):
    """Each string of the pieces, by its own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (hashlib.blake2b(data[i : i + length], digest_size=16).digest(), key, content, i)
                for key, content, data in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "data")), strict=True)
                for i in range(len(data) - length + 1)
            ]
            if out:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["name", "key", "content", "low"])

    return run


def _sorted_fragments(length: int):
    """The fragments of a group, some megabyte at a time and keys kept together: (key, content, low, high) runs of repeated starts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "content"], kind="stable")
        g, f, data = pdf["key"].to_numpy(), pdf["content"].to_numpy(), pdf["data"].tolist()
        out: list[tuple] = []
        begin, size = 0, 0
        for i in range(len(g) + 1):
            if i == len(g) or size > ARRAY_BYTES and g[i] != g[i - 1]:
                for j, starts in zip(range(begin, i), repeated_starts(data[begin:i], length) if i > begin else [], strict=True):
                    if len(starts):
                        breaks = np.flatnonzero(np.diff(starts) > 1)
                        for a, b in zip(np.append(starts[0], starts[breaks + 1]), np.append(starts[breaks], starts[-1]), strict=True):
                            out.append((g[j], f[j], int(a), int(b) + 1))
                begin, size = i, 0
            if i < len(g):
                size += len(data[i])
        release()
        return pd.DataFrame(out, columns=["key", "content", "low", "high"])

    return run


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with the two halves of their texts' 128-bit names, c1 and c2; null texts are empty."""
    empty = F.lit("").cast(docs.schema["text"].dataType)
    return docs.withColumn("text", F.coalesce("text", empty)).withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64("text", F.lit(1))})


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans of bytes under a string of ``length`` bytes that also starts elsewhere, by text: c1, c2, spans (sorted), and of the text least (an id that has it), copies and n (bytes).

    ``rows``: id, text (or bytes), c1, c2.
    """
    scratch = Scratch(rows.sparkSession)
    cut = scratch.cut
    classes = rows.groupBy("c1", "c2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("n"))
    classes = cut(classes, "suffix-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * int(total) // (length - BLOCK) // GROUP))
    dealt = rows.select("c1", "c2", "text").mapInArrow(released(_fragments(length, groups)), "group int, kind binary, " + ", ".join(f"{c} binary" for c in _PLACE))
    fragments = cut(dealt.groupBy("group").applyInPandas(_shared, "g long, f long, c1 long, c2 long, first long, count int, at int"), "suffix-fragments")
    place = F.struct("c1", "c2", "first", "count", "at")
    kinds = cut(fragments.groupBy("g", "f").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count("*").alias("n")), "suffix-kinds")
    often = F.col("one") != F.col("other")
    several = cut(kinds.groupBy("g").count().filter("count > 1").select("g", (F.col("count") > HOT).alias("hot")), "suffix-several")
    # fragments that repeat whole need no sorting; where an anchor has several, their bytes are sorted
    mixed = kinds.join(several, "g").select("g", "f", "one.*", "hot")
    asked = mixed.groupBy("c1", "c2").agg(F.collect_list(F.struct("g", "f", "first", "count", "at", "hot")).alias("asked"))
    asked = cut(asked.join(classes.select("c1", "c2", "least"), ["c1", "c2"]), "suffix-asked")
    near = of_classes(rows, asked, "asked", 48)
    pieces = near.select("text", "asked").mapInArrow(released(_cutouts(length)), "key long, content long, g long, f long, base int, data binary, hot boolean")

    def in_arrays(some: DataFrame, size: int) -> DataFrame:
        """Repeated starts of fragments (key, content, data), a group of keys to a suffix array; ``size``: their bytes."""
        dealt = some.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(max(1, int(size) // (2 * ARRAY_BYTES)))))
        return dealt.groupBy("group").applyInPandas(_drop(_sorted_fragments(length)), "key long, content long, low int, high int")

    n = mixed.agg(F.coalesce(F.sum(F.col("count") + length), F.lit(0))).first()[0]
    hot = several.filter("hot").limit(1).count() > 0
    pieces = cut(pieces, "suffix-pieces") if hot else pieces
    partly = in_arrays(pieces.filter("not hot").select("key", "content", "data"), n).select(F.col("key").alias("g"), F.col("content").alias("f"), "low", "high")
    if hot:
        # the same again, one level below: pieces equal whole repeat, and one of each kind is sorted with its key's others
        fine = pieces.filter("hot")
        own = cut(fine.groupBy("key", "content").agg(F.count_distinct("g", "f").alias("n"), F.first("data").alias("data")), "suffix-fine")
        others = cut(own.groupBy("key").count().filter("count > 1"), "suffix-others")
        split = cut(others.filter(F.col("count") > HOT).select("key"), "suffix-split")
        sorted_ = own.join(others.filter(F.col("count") <= HOT).select("key"), "key").select("key", "content", "data")
        size = sorted_.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        equal = own.filter("n > 1").select("key", "content", F.lit(0).alias("low"), (F.octet_length("data") - length + 1).alias("high"))
        again = equal.unionByName(in_arrays(sorted_, size))
        if split.limit(1).count():
            # once more, string by string: those of a key that stand in two pieces are counted, in grouped sums
            strings = cut(own.join(few(split, "key", width=0), "key").select("key", "content", "data").mapInArrow(released(_strings(length)), "name binary, key long, content long, low int"), "suffix-strings")
            twice = cut(strings.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-twice")
            again = again.unionByName(joined_by(strings, twice, ["name"], "n", strings.count()).select("key", "content", "low", (F.col("low") + 1).alias("high")))
        again = cut(again, "suffix-again")
        partly = partly.unionByName(fine.select("key", "content", "g", "f", "base").join(again, ["key", "content"]).select("g", "f", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high")))
    partly = cut(partly.distinct(), "suffix-partly")
    whole = kinds.filter(often).select("g", "f", "n", F.array(F.struct(F.lit(0).alias("low"), F.lit(1 << 30).alias("high"))).alias("runs"))
    partly = partly.groupBy("g", "f").agg(F.collect_list(F.struct("low", "high")).alias("runs")).join(kinds.filter(~often).select("g", "f", "n"), ["g", "f"])
    facts = cut(whole.unionByName(partly.select("g", "f", "n", "runs")), "suffix-facts")
    found = joined_by(fragments, facts, ["g", "f"], "n", fragments.count()).select("c1", "c2", "first", "count", F.explode("runs").alias("run")).select("*", "run.*")
    start = F.col("first") + F.col("low")
    spans = found.select("c1", "c2", start.alias("start"), (F.col("first") + F.least("high", "count") - 1 + length).alias("end"))
    copied = classes.filter((F.col("copies") > 1) & (F.col("n") >= length)).select("c1", "c2", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    merged = spans.unionByName(copied).groupBy("c1", "c2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out = common_cut(_whole(merged).join(classes, ["c1", "c2"]), "suffix-spans")
    scratch.clear()
    return out


def of_classes(rows: DataFrame, asked: DataFrame, lists: str, width: int) -> DataFrame:
    """``asked`` (c1, c2, least, an array of ``width`` bytes an element) with a text of each class; by broadcast if it is few bytes."""
    asked = few(asked, "least", width=F.lit(48) + width * F.size(lists))
    own = rows.select(F.col("id").alias("least"), "c1", "c2", "text")
    if asked.filter("least is null").limit(1).count():
        return own.drop("least").join(asked, ["c1", "c2"])
    return own.join(asked, ["c1", "c2", "least"])


def _regions(length: int):
    """(c1, c2, start, text) of the merged spans of ``length`` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c1, c2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "text", "spans")), strict=True):
                data = _bytes(text)
                out.extend((c1, c2, a, data[a:b]) for a, b in _joined(spans) if b - a >= length)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [*[pa.int64()] * 3, pa.binary()], strict=True)], ["c1", "c2", "start", "text"])

    return run


def repeated_within(rows: DataFrame, wide: DataFrame, length: int) -> DataFrame:
    """Spans of ``length`` bytes as :func:`repeated_spans`, looked for in the spans of fewer bytes alone, in which they all lie."""
    regions = of_classes(rows, wide, "spans", 24).select("c1", "c2", "text", "spans").mapInArrow(released(_regions(length)), "c1 long, c2 long, start long, text binary")
    regions = common_cut(named(regions.withColumnsRenamed({"c1": "d1", "c2": "d2"}).withColumn("id", F.xxhash64("d1", "d2", "start"))), "suffix-regions")
    found = repeated_spans(regions, length).select("c1", "c2", F.explode("spans").alias("span"))
    each = regions.select("c1", "c2", "d1", "d2", "start").join(found, ["c1", "c2"])
    each = each.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.struct((F.col("start") + F.col("span.start")).alias("start"), (F.col("start") + F.col("span.end")).alias("end")).alias("span"))
    copied = wide.filter((F.col("copies") > 1) & (F.col("n") >= length)).select("c1", "c2", F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end")).alias("span"))
    each = each.unionByName(copied)
    return common_cut(_whole(each.groupBy("c1", "c2").agg(F.sort_array(F.collect_set("span")).alias("spans"))), "suffix-within")


def _whole(spans: DataFrame) -> DataFrame:
    """c1, c2 and their spans, overlapping and touching ones as one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [[{"start": a, "end": b} for a, b in _joined(x)] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c1"), batch.column("c2"), pa.array(joined, kind)], ["c1", "c2", "spans"])

    return spans.select("c1", "c2", "spans").mapInArrow(run, "c1 long, c2 long, spans array<struct<start: long, end: long>>")


def _joined(spans: list) -> Iterator[tuple[int, int]]:
    """Overlapping and touching spans as one, of spans sorted by start."""
    start, end = None, None
    for s in spans or ():
        if start is None or s["start"] > end:
            if start is not None:
                yield start, end
            start, end = s["start"], s["end"]
        end = max(end, s["end"])
    if start is not None:
        yield start, end


def _drop(run):
    return lambda pdf: run(pdf.drop(columns="group"))


def _kept(data: bytes, spans: list) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal runs inside."""
    out, at, runs = [], 0, 0
    for start, end in _joined(spans):
        out.append(data[at:start])
        at, runs = end, runs + 1
    return b"".join([*out, data[at:]]), runs


def _with_spans(rows: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``rows`` with their class's spans as ``name``: by broadcast if these are few bytes, else by a join that splits large classes."""
    own = spans.select("c1", "c2", F.col("spans").alias(name))
    return rows.join(few(own, "c1", width=F.lit(48) + 24 * F.size(name)), ["c1", "c2"], "left")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte under a string of ``length`` bytes that starts anywhere else too: id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared.

    n_shared counts the bytes under such strings of ``passage`` (at most ``length``) bytes, which are not removed.
    Every string has an anchor chosen by content, and equal strings have equal anchors, so
    strings are dealt by anchor as fragments.  Fragments that are equal whole are
    known by hash; of the others one copy each is sorted by a difference-cover suffix array with
    its anchor's other fragments, and neighbours' prefixes are compared.  Equal texts are one class.  The longer strings
    are sorted anew, within what the shorter ones cover.
    Texts are judged as UTF-8 bytes and never joined; null texts are empty; overlaps and
    repeats inside a text count; null and repeated ids are rows like others; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = named(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    wide = repeated_spans(rows, passage)
    removed = repeated_within(rows, wide, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, gone, shared in zip(batch.column("text"), batch.column("gone").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                data = _bytes(text.as_py())
                kept, runs = _kept(data, gone)
                out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in _joined(shared))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    out = _with_spans(_with_spans(rows, removed, "gone"), wide, "shared").select("id", "text", "gone", "shared")
    return out.mapInArrow(released(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every byte under a string of ``length`` bytes that starts anywhere else too taken out of their texts; a character that is cut into goes whole.

    All rows and columns stay, whatever their names; null texts stay null; an empty table stays empty.
    """
    rows = named(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")))

    @F.pandas_udf("string")
    @giving_back
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_kept(_bytes(t), f)[0].decode("utf-8", "ignore") for t, f in zip(texts, found.map(lambda f: () if f is None else list(f)), strict=True)], dtype=object)

    out = _with_spans(rows, repeated_spans(rows, length), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(cleaned("text", "gone"))
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
