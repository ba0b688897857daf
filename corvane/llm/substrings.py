"""Removal of passages of words that an earlier document has, by suffix trees over groups of suffixes that share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import STARTS, Scratch, few, joined_by, least_places, mix64, prefix_hash, release, released, span_hash
from corvane.llm.common import cut as common_cut

#: Words of a passage, and of the blocks whose hashes choose the word where its suffixes are grouped.
LENGTH, BLOCK = 50, 8
#: A group of more different strings gets a longer prefix: RANGES has the windows that a string then holds, level by level.
HOT, RANGES = 2_000, (8, 1)
#: Words of the strings that one task's trees are built over.
TREE_WORDS = 300_000

_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(data: bytes) -> list[bytes]:
    """Runs of bytes other than space, tab, line ends and form feeds."""
    return data.split()


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def block_hashes(words: list[bytes], block: int) -> np.ndarray:
    """A hash of each ``block`` neighbouring words; it only deals strings to groups, equality is judged by the words."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    end = np.flatnonzero(data == 32)
    start = np.append(0, end[:-1] + 1)
    with np.errstate(over="ignore"):
        own = span_hash(prefix_hash(data), start, end)
        n = len(own) - block + 1
        powers = _powers(block)
        total = np.zeros(n, np.uint64)
        for i in range(block):
            total += own[i : i + n] * powers[i]
        return mix64(total)


def fragments(words: list[bytes], length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, first window, count of windows, place of the shared block in the first) of the runs of windows that share their chosen block.

    A window's block is that of least hash, so equal windows have equal blocks at equal places: their suffixes meet in one group.
    """
    if len(words) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes, window = block_hashes(words, block), length - block + 1
    found = []
    for begin in range(0, len(words) - length + 1, STARTS):
        own = hashes[begin : begin + STARTS + window - 1]
        at = least_places(own, window)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found.append((own[at[first]].view(np.int64), begin + first, np.diff(np.append(first, len(at))), at[first] - first))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digest(words: list[bytes], place: int) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16, salt=place.to_bytes(8, "little")).digest()


_ROW = "key long, digest binary, c1 long, first int, count int, at int"


def _first_rows(length: int, block: int):
    """Each text's fragments: the first level's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, columns, digests = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                key, first, count, at = fragments(words, length, block)
                source.append(np.full(len(key), i))
                columns.append((key, first, count, at))
                digests += [_digest(words[a : a + n + length - 1], p) for a, n, p in zip(first.tolist(), count.tolist(), at.tolist(), strict=True)]
            if not digests:
                continue
            source = pa.array(np.concatenate(source))
            key, first, count, at = (np.concatenate(x) for x in zip(*columns, strict=True))
            arrays = [batch.column("id").take(source), pa.array(key), pa.array(digests, pa.binary()), batch.column("c1").take(source), *(pa.array(x.astype(np.int32)) for x in (first, count, at))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "digest", "c1", "first", "count", "at"])

    return run


def _next_rows(length: int, size: int):
    """The asked strings cut into ranges of ``size`` windows by their place from the block, keyed by all words that a range's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, out = [], []
            for i, (text, asked) in enumerate(zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True)):
                words = words_of(text.as_py())
                for x in asked:
                    first, block = x["first"], x["first"] + x["at"]
                    for r in range((x["at"] - x["count"] + 1) // size, x["at"] // size + 1):
                        low, high = max(first, block - (r + 1) * size + 1), min(first + x["count"] - 1, block - r * size)
                        core = words[block - r * size : block - (r + 1) * size + 1 + length]
                        key = int.from_bytes(_digest(core, r)[:8], "little", signed=True)
                        source.append(i)
                        out.append((key, _digest(words[low : high + length], block - low), low, high - low + 1, block - low, (x["key"], x["digest"]), low - first))
            if not out:
                continue
            source = pa.array(source)
            key, digest, first, count, at, ref, base = zip(*out, strict=True)
            refs = pa.StructArray.from_arrays([pa.array([r[0] for r in ref]), pa.array([r[1] for r in ref], pa.binary())], ["key", "digest"])
            ints = [pa.array(x, pa.int32()) for x in (first, count, at)]
            arrays = [batch.column("id").take(source), pa.array(key), pa.array(digest, pa.binary()), batch.column("c1").take(source), *ints, refs, pa.array(base, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "digest", "c1", "first", "count", "at", "ref", "base"])

    return run


def _cutouts(length: int):
    """The asked strings' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, asked) in enumerate(zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True)):
                words = words_of(text.as_py())
                data = [b" ".join(words[x["first"] : x["first"] + x["count"] + length - 1]) for x in asked]
                arrays = [pa.array([x["key"] for x in asked], pa.int64()), pa.array([x["digest"] for x in asked], pa.binary()), batch.column("id").take(pa.array([i] * len(asked), pa.int64())), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", "id", "words"])

    return run


def deep_nodes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The node at depth ``length`` of each start's suffix, in the suffix tree of whole numbers.

    The tree is grown downwards by doubling: a node of depth 2d is the pair of the nodes of depth d that its two halves reach, so every
    name stands for one string exactly.  Suffixes that share their node are a repeat; one alone is a leaf.
    """
    node, depth = text, 1
    padded = lambda x, n: np.append(x[n:], np.full(min(n, len(x)), -1))
    pair = lambda a, b: pd.factorize(a.astype(np.int64) * (int(b.max(initial=0)) + 2) + b + 1)[0]
    while depth * 2 <= length:
        node, depth = pair(node, padded(node, depth)), depth * 2
    return pair(node[starts], padded(node, length - depth)[starts])


def _trees(length: int):
    """The groups of a task, each string once: the runs of windows (key, digest, low, high) that a string of a smaller id has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "digest"])
        strings = [x.split(b" ") for x in pdf["words"]]
        sizes = np.array([len(x) for x in strings])
        text = pd.factorize(np.array([w for x in strings for w in x], dtype=object))[0]
        end = np.cumsum(sizes)
        windows = sizes - length + 1
        own = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        node = deep_nodes(text, (end - sizes)[own] + place, length)
        rank = pdf["id"].rank(method="dense").to_numpy().astype(np.int64)[own]
        least = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, rank)
        at = np.flatnonzero(least[node] < rank)
        ends = np.flatnonzero(np.append((np.diff(at) > 1) | (np.diff(own[at]) > 0), True)) if len(at) else np.zeros(0, np.int64)
        low, high = at[np.append(0, ends[:-1] + 1)] if len(at) else at, at[ends]
        which = own[low]
        out = pd.DataFrame({"key": pdf["key"].to_numpy()[which], "digest": pdf["digest"].to_numpy()[which], "low": place[low].astype(np.int32), "high": (place[high] + 1).astype(np.int32)})
        release()
        return out

    return run


def _cut_from(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``texts`` that hold one of the ``places`` (id, c1, key, digest, first, count, at), with those as ``asked``."""
    asked = places.groupBy("id", "c1").agg(F.collect_list(F.struct("key", "digest", "first", "count", "at")).alias("asked"))
    return texts.join(few(asked, "id", width=F.lit(32) + 64 * F.size("asked")), ["id", "c1"])


def _resolved(rows: DataFrame, texts: DataFrame, length: int, level: int, hot: int, scratch: Scratch) -> DataFrame:
    """(ref, low, high): windows of each row's string, from its base on, that a row of a smaller id has too.

    ``rows``: id, key, digest, c1, first, count, at, ref, base.  Rows equal whole are one kind: all but those of its least id are settled.
    Of a key with several kinds, one string each is cut out of its text and goes into a tree, or, if the kinds are
    too many for one task, to the next level, where a key is longer and a string shorter; at the last, a string is a window and
    its own key, so that every key has one kind.
    """
    cut = scratch.cut
    id_kind = rows.schema["id"].dataType.simpleString()
    total = rows.count()
    kinds = cut(rows.groupBy("key", "digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")), f"substring-kinds-{level}")
    keys = kinds.groupBy("key").agg(F.min("least").alias("low"), F.max("most").alias("high"), F.count("*").alias("kinds")).filter("low < high").select("key", "kinds")
    keys = cut(keys, f"substring-keys-{level}")
    facts = cut(joined_by(kinds, keys, ["key"], "kinds", total).filter("kinds > 1 or least < most").select("key", "digest", "least", "n", "kinds"), f"substring-facts-{level}")
    shared = cut(joined_by(rows, facts, ["key", "digest"], "n", total), f"substring-shared-{level}")
    whole = shared.filter("id > least").select("ref", F.col("base").alias("low"), (F.col("base") + F.col("count")).alias("high"))

    first = shared.filter("id = least and kinds > 1").groupBy("key", "digest", "id", "kinds").agg(F.min(F.struct("c1", "first", "count", "at")).alias("one"))
    places = cut(first.select("key", "digest", "id", "kinds", "one.*"), f"substring-places-{level}")
    few_kinds, many = places.filter(F.col("kinds") <= hot), places.filter(F.col("kinds") > hot)
    size = few_kinds.agg(F.coalesce(F.sum(F.col("count") + length), F.lit(0))).first()[0]
    pieces = _cut_from(texts, few_kinds).select("id", "asked", "text").mapInArrow(released(_cutouts(length)), f"key long, digest binary, id {id_kind}, words binary")
    groups = pieces.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(max(1, size // TREE_WORDS))))
    trees = _trees(length)
    partly = groups.groupBy("group").applyInPandas(lambda pdf: trees(pdf.drop(columns="group")), "key long, digest binary, low int, high int")
    if many.limit(1).count():
        deeper = _cut_from(texts, many).select("id", "c1", "asked", "text").mapInArrow(released(_next_rows(length, RANGES[level])), f"id {id_kind}, {_ROW}, ref struct<key: long, digest: binary>, base int")
        below = _resolved(cut(deeper, f"substring-rows-{level + 1}"), texts, length, level + 1, hot, scratch)
        partly = partly.unionByName(below.select("ref.key", "ref.digest", "low", "high"))
    partly = cut(partly.groupBy("key", "digest").agg(F.collect_set(F.struct("low", "high")).alias("runs")), f"substring-partly-{level}")
    own = shared.filter("id = least and kinds > 1").select("key", "digest", "ref", "base").join(partly, ["key", "digest"]).select("ref", "base", F.explode("runs").alias("run"))
    return whole.unionByName(own.select("ref", (F.col("base") + F.col("run.low")).alias("low"), (F.col("base") + F.col("run.high")).alias("high")))


def repeated_passages(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Spans of words under a window of ``length`` words that a row of a smaller id has too: id, c1, spans (start, end).  ``rows``: id, c1, text (bytes)."""
    scratch = Scratch(rows.sparkSession)
    texts = rows.filter("id is not null")
    id_kind = rows.schema["id"].dataType.simpleString()
    first = texts.select("id", "c1", "text").mapInArrow(released(_first_rows(length, min(BLOCK, length))), f"id {id_kind}, {_ROW}")
    first = scratch.cut(first, "substring-rows-0").withColumns({"ref": F.struct("id", "c1", "first"), "base": F.lit(0)})
    found = _resolved(first, texts, length, 0, hot, scratch)
    start = F.col("ref.first") + F.col("low")
    spans = found.select("ref.id", "ref.c1", F.struct(start.alias("start"), (F.col("ref.first") + F.col("high") - 1 + length).alias("end")).alias("span"))
    out = common_cut(spans.groupBy("id", "c1").agg(F.sort_array(F.collect_set("span")).alias("spans")), "substring-spans")
    scratch.clear()
    return out


def _covered(n: int, spans: list | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge)[:n] > 0


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Remove every word under a window of ``length`` words that also starts in a document of a smaller id: id_col, n_words, n_removed, kept_sha256.

    Each window goes to the group of its block of least hash, with the run of windows that share it: a string, in which every word
    is sent about three times.  Groups with one document, and strings that are equal whole, are settled by their digests; the others' suffixes make a
    tree a group, whose nodes as deep as a window are the repeats.  Groups with too many strings for one task are split by longer
    shared prefixes, down to whole windows, which are counted in grouped sums.

    Null texts have no words; rows of a null id neither remove nor lose words; rows of one id do not remove from each other, whether
    their texts differ or not; texts of fewer words than a window stay whole; long texts are read whole; other columns are not read;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("c1"), text.cast("binary").alias("text"))
    spans = repeated_passages(rows, length, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text.as_py())
                gone = _covered(len(words), found)
                kept = words if not found else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True))], ["id", "n_words", "n_removed", "kept_sha256"])

    own = rows.join(few(spans, "id", width=F.lit(32) + 16 * F.size("spans")), ["id", "c1"], "left")
    return own.select("id", "text", "spans").mapInArrow(released(run), f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


#: The same by a table of all windows.
SUBSTRING_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 e AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 x AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i : i + 49], ' ') END AS window_text FROM e),
 m AS (SELECT window_text, min(doc_id) AS least FROM x WHERE window_text IS NOT NULL GROUP BY window_text),
 y AS (SELECT x.r, x.i, x.word, max(CASE WHEN m.least < x.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN m ON m.window_text = x.window_text),
 z AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM y GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(z.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (r)"""
