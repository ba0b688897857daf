"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Longest pre-token (characters) whose ids are remembered, and how many are; then the memory starts anew.
CACHED_CHARS, CACHED = 48, 800_000


#: The letters, numbers and white space among the characters up to U+024F.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_LATIN = re.compile("[\x00-\u024f]*").fullmatch


def latin_finder(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's ``findall`` for texts of characters up to U+024F, on the faster standard engine."""
    names = {r"\p{L}": _L, r"\p{N}": _N, r"\s": _S}
    whole = re.sub(r"\[\^?[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda x: names[x[0]], m[0]), pattern)
    whole = whole.replace(r"\S", f"[^{_S}]")
    for name, members in names.items():
        whole = whole.replace(name, f"[{members}]")
    return re.compile(whole).findall


class ByteBPE:
    """Ranks by token bytes; ids are ranks.  ``pattern`` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.find, self.find_latin = regex.compile(pattern).findall, latin_finder(pattern)
        self.cache = _Cache(self)

    def split(self, text: str) -> list[str]:
        return self.find_latin(text) if _LATIN(text) else self.find(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank next, leftmost first.

        The queue keeps, for each merge rank, a heap of the positions whose token and
        its successor join at that rank.  Two bitmap levels of 256 bits name the ranks
        with positions; the lowest set bit of each gives the next rank.  Merging leaves
        entries behind; one whose position has another rank by now is skipped.
        """
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        ids = [self.single[c] for c in piece]
        end, before = list(range(1, n + 2)), list(range(-1, n))  # where a token ends, so its successor; its predecessor
        pair: list[int | None] = [None] * (n + 1)
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is not None:
                pair[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)  # positions come in order, so the list is a heap
                else:
                    buckets[rank] = [at]
                    group = rank >> 8
                    low[group] = low.get(group, 0) | 1 << (rank & 255)
                    top |= 1 << group
        while top:
            group = (top & -top).bit_length() - 1
            bits = low[group]
            lowest = bits & -bits
            rank = group << 8 | lowest.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                low[group] = bits = bits ^ lowest
                if not bits:
                    top ^= 1 << group
            if pair[at] != rank:
                continue
            gone = end[at]
            stop = end[at] = end[gone]
            ids[at], pair[gone], pair[at] = rank, None, None
            left = before[at]
            changed = [(left, piece[left:stop])] if left >= 0 else []
            if stop < n:
                before[stop] = at
                changed.append((at, piece[at : end[stop]]))
            for place, joined in changed:
                pair[place] = rank = get(joined)
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], place)
                    else:
                        buckets[rank] = [place]
                        group = rank >> 8
                        low[group] = low.get(group, 0) | 1 << (rank & 255)
                        top |= 1 << group
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = end[at]
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        values = array("I")
        values.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, values))


class _Cache(dict):
    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.bpe.merge(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; one pass over the scan, no shuffle.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, one row per input row.
    Null texts count as empty (no ids); ids may be null or repeated; other columns
    are not read.  A pre-token of any length is merged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(ranks_path, pattern), hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
