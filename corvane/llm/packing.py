"""Harmonic packing of token sequences into fixed-capacity bins."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from corvane.llm.common import release, released

CAPACITY = 2048
#: Pieces of at most CAPACITY / CLASSES tokens share bins filled one after the other.
CLASSES = 32
#: A class takes pieces uncut if a bin of them wastes at most this share of the capacity.
SLACK = 0.01
#: How many chunks' ids are remembered, and the longest one that is.
CACHED, CACHED_BYTES = 400_000, 64
#: Texts of characters up to U+00FF: composed already, and their lower case is one character for each.
LATIN = re.compile("[\x00-\xff]*").fullmatch
#: Byte-level tokenizers write the bytes 0-32, 127-160 and 173 as the letters from U+0100 on.
BYTE_LETTERS = {byte: 0x100 + i for i, byte in enumerate([*range(33), *range(127, 161), 173])}


class ChunkIds(dict):
    """Ids of texts by way of their white-space free chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are
    its chunks' ids, one after the other.  A chunk that is not known yet is looked up as the
    lower-case word and the full stops and commas after it, which the tokenizer treats apart;
    a word of letters up to U+00FF goes to the tokenizer's model at once, anything else through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        low = text.lower() if LATIN(text) else text
        word = low.rstrip(".,")
        if word.isalpha() and LATIN(word):
            ids = self._word(word) + (self[low[len(word) :].encode()] if len(word) < len(low) else b"")
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._keep(chunk, ids)

    def _word(self, word: str) -> bytes:
        name = word.encode()
        if (ids := self.get(name)) is None:
            letters = name.decode("latin-1").translate(BYTE_LETTERS)
            ids = self._keep(name, array("I", [x.id for x in self.model.tokenize(letters)]).tobytes())
        return ids

    def _keep(self, chunk: bytes, ids: bytes) -> bytes:
        if len(chunk) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """The tokenizer's ids; what reading its file took is given back at once, not at the end of the first task."""
    out = ChunkIds(path)
    release()
    return out


def pieces(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(piece length, class) of a document of ``length`` tokens; class 0: the small ones.

    Class k holds lengths in (capacity / (k + 1), capacity / k], k to a bin.  What
    would leave more than SLACK of its bin empty is cut at the next class's top length.
    """
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest > capacity // CLASSES:
        k = capacity // rest
        if capacity - k * rest <= SLACK * capacity:
            out.append((rest, k))
            return out
        top = capacity // (k + 1)
        out.append((top, k + 1))
        rest -= top
    if rest:
        out.append((rest, 0))
    return out


class Packer:
    """One worker's open bins.  ``put`` and ``close`` yield (piece row, sequence, offset)."""

    def __init__(self, first: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}
        self.small: list[tuple] = []
        self.small_used = 0

    def _emit(self, row: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in row:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def put(self, doc: object, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        for length, k in pieces(total, self.capacity):
            piece = (doc, at, ids[4 * at : 4 * (at + length)], total)
            at += length
            if k == 0:
                yield from self._small(piece)
                continue
            row = self.open.setdefault(k, [])
            row.append(piece)
            if len(row) == k:
                del self.open[k]
                yield from self._emit(row)

    def _small(self, piece: tuple) -> Iterator[tuple]:
        doc, start, ids, total = piece
        while ids:
            room = 4 * (self.capacity - self.small_used)
            self.small.append((doc, start, ids[:room], total))
            self.small_used += len(ids[:room]) // 4
            start, ids = start + room // 4, ids[room:]
            if self.small_used == self.capacity:
                row, self.small, self.small_used = self.small, [], 0
                yield from self._emit(row)

    def close(self) -> Iterator[tuple]:
        """Bins that no worker input fills any more: their pieces are cut to fill bins, the rest to powers of two."""
        for k in sorted(self.open):
            for piece in self.open[k]:
                yield from self._small(piece)
        self.open = {}
        row, left = self.small, self.small_used
        while left:
            size, out = 1 << left.bit_length() - 1, []
            left -= size
            while size:
                doc, start, ids, total = row[0]
                take = min(size, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], total))
                row[:1] = [(doc, start + take, ids[4 * take :], total)] if 4 * take < len(ids) else []
                size -= take
            yield from self._emit(out)


def harmonic_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every text and pack the ids, one pass without a shuffle; workers pack apart from one another.

    A document is its ids and then ``end_id``; null and empty texts are ``end_id``
    alone.  Returns, for each piece, id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Full bins of class k hold k pieces.  At the end of a
    partition what is left is cut to fill bins, and the last bin's tokens go into
    sequences of a power of two, which need no padding.  A worker keeps at most
    capacity tokens a class.  sequence_id is partition * 2**33 + running number, so
    a recomputed task gives the same ids.  An empty table gives no rows; ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = chunk_ids(tokenizer_path).encode, Packer(TaskContext.get().partitionId() << 33, capacity)
        last, out = array("I", [end_id]).tobytes(), []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [id_kind, *[pa.int64()] * 6], strict=True)], names)

        id_kind, names = pa.int64(), ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            id_kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.extend(packer.put(doc, encode(text.as_py() or "") + last))
                if len(out) >= 20_000:
                    yield block(out)
                    out = []
        out.extend(packer.close())
        if out:
            yield block(out)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(released(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
