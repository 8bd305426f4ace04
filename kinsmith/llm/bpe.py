"""Byte-level BPE encoding and decoding by a file of ranks.

Two tiers: a minimal perfect hash tells whole pre-tokens that are in the vocabulary; the others are merged with a heap
over linked bytes, in n log n steps for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import column_slices, require, small_batches

_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys to 0..n-1. Keys of a bucket share the number that places them all."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.size, self.buckets = max(1, len(keys)), max(1, len(keys) // per_bucket)
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            x = xxhash.xxh3_128_intdigest(k)
            groups[(x >> 64) % self.buckets].append((x & _MASK, x >> 64))
        taken, free = bytearray(self.size), None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if not (group := groups[b]):
                break
            if len(group) == 1:  # placed in any free slot, kept as a negative number
                free = free if free is not None else (i for i in range(self.size) if not taken[i])
                self.shift[b] = -next(free) - 1
                continue
            d = 1
            while True:
                slots = {((lo + d * (hi | 1)) & _MASK) % self.size for lo, hi in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s in slots:
                taken[s] = 1

    def __call__(self, key: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(key)
        hi = x >> 64
        d = self.shift[hi % self.buckets]
        return -d - 1 if d < 0 else (((x & _MASK) + d * (hi | 1)) & _MASK) % self.size


class Vocabulary:
    """Tokens by id, and by the perfect hash. Every single byte has to be a token."""

    def __init__(self, ranks: bytes):
        self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        keys = list(self.rank)
        self.hash = PerfectHash(keys)
        self.key_at, self.id_at = [b""] * self.hash.size, [0] * self.hash.size
        for k in keys:
            self.key_at[at := self.hash(k)] = k
            self.id_at[at] = self.rank[k]
        self.token = {i: k for k, i in self.rank.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        at = self.hash(piece)
        return [self.id_at[at]] if self.key_at[at] == piece else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        """Always the pair of least rank first, of equal ones the leftmost."""
        n, rank = len(piece), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:  # one of the two has since been merged
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return out


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


class _Packed(dict):
    """pre-token -> its ids as little-endian 32-bit integers; forgets all when it holds more than `most`."""

    def __init__(self, v: Vocabulary, most: int = 400_000):
        super().__init__()
        self.v, self.most = v, most

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.v.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        self.v = vocabulary(ranks)
        self.find, self.packed = regex.compile(pattern).findall, _Packed(self.v)

    def encode(self, text: str | None) -> bytes:
        if len(self.packed) > self.packed.most:
            self.packed.clear()
        return b"".join(map(self.packed.__getitem__, self.find(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _source(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return f.read(), pattern


def _by_codec(df: DataFrame, path: str | None, pattern: str | None, fields: str, column: str, make: Callable) -> DataFrame:
    """Add fields to (doc_id, column): the rank file travels with the task, so executors need no copy of it."""
    (ranks, pattern), names = _source(path, pattern), [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for part in column_slices(batches, 256):
            cols = list(zip(*(make(codec, x) for x in part[column]), strict=True)) or [()] * len(names)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), *(pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, fields.split(", "), strict=True))], ["doc_id", *names])

    require(df, "doc_id", column)
    return small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), column).mapInArrow(run, f"doc_id long, {fields}")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids), ids packed as little-endian unsigned 32-bit integers."""
    return _by_codec(docs, path, pattern, "n_tokens long, ids binary", "text", lambda c, t: (len(ids := c.encode(t)) // 4, ids))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes)."""
    return _by_codec(encoded, path, pattern, "bytes binary", "ids", lambda c, ids: (c.decode(ids or b""),))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding in one pass.

    A null or empty text has no tokens and the digests of no bytes. Null doc_id and repeated rows stay as they are, a row
    for each row; other columns are ignored; an empty table gives no rows. Special tokens' strings are ordinary text.
    """

    def both(c: Codec, text: str | None) -> tuple:
        ids = c.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _by_codec(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", "text", both)
