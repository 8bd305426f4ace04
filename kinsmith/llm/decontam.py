"""Benchmark decontamination.

For every item, all windows with as many words as it has, clipped at the text's ends, are fingerprinted by a weighted
128-bit SimHash of their five-word shingles; windows that share no shingle with an item of that length are left out, as
their similarity is 0. Fingerprints slide: sums of the shingles' bits come from running totals, with repeated shingles
taken out. Fingerprints within RADIUS bits of an item's are found by multi-index hashing: both are cut into 16 blocks of 8
bits, and of two fingerprints that differ in at most 42 bits some block differs in at most 2, so looking up every block with
its neighbours of up to 2 bits misses none. Every candidate is then verified by the exact weighted Jaccard similarity of the
shingle sets. At similarity 0.75 two fingerprints differ in 22 bits on average, with a deviation of 4.3.

A shingle weighs log(1 + items / items with it). Items are counted over the whole benchmark by 2^20 bins of the shingles'
hashes, so what is known of the benchmark's frequencies has one size, and an item's matches don't depend on how a large
benchmark is cut into parts. Everything runs where the documents are; only the benchmark travels.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import WordHashes, column_slices, mix, require, shingle_hashes, small_batches, words_of

SHINGLE, LEAST = 5, 0.75
RADIUS, BLOCKS, NEAR = 42, 16, 2
#: Characters of benchmark text that are sent to the tasks at once; a larger benchmark is taken in parts.
MOST_CHARS = 16_000_000
#: Bins that items are counted by, and in which a shingle is looked up first.
BIN_BITS = 20
#: Windows that are fingerprinted at once, and shingles of which the bits are summed at once.
WINDOWS, BLOCK = 2048, 8192
_SHIFT = np.uint64(64 - BIN_BITS)


def _bins(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _SHIFT).astype(np.int64)


def _shingles(text: str | None, hashes: WordHashes) -> tuple[int, np.ndarray]:
    """Words of a text, and its shingles in order."""
    h = hashes.of(words_of(text))
    return len(h), shingle_hashes(h, SHINGLE)


class Weights:
    """Shingles' weights by the number of items in their bin; a bin without items counts as one."""

    def __init__(self, n: int, bins: np.ndarray, counts: np.ndarray):
        self.n, self.bins, self.counts = n, bins.astype(np.int32), counts.astype(np.int64)

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Weights:
        hashes, counts, n = WordHashes(), Counter(), 0
        for _, text in items:
            k, s = _shingles(text, hashes)
            n += k > 0
            counts.update(_bins(np.unique(s)).tolist())
        return cls(n, np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))

    def table(self) -> np.ndarray:
        counts = np.ones(1 << BIN_BITS, np.int64)
        counts[self.bins] = self.counts
        return np.log(1 + max(1, self.n) / counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words (bin -1) and items by bin."""
    hashes, n, counts = WordHashes(), 0, np.zeros(1 << BIN_BITS, np.int64)
    for part in column_slices(batches):
        for text in part["text"]:
            k, s = _shingles(text, hashes)
            n += k > 0
            np.add.at(counts, _bins(np.unique(s)), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *counts[at].tolist()], pa.int64())], ["bin", "n"])


class Group:
    """Items of one length in words: their fingerprints, and for each block the items near each of its values, as bits."""

    def __init__(self, members: list[int], prints: np.ndarray):
        self.members, self.prints = members, np.ascontiguousarray(prints).view(np.uint64)
        values = np.arange(256, dtype=np.uint8)
        self.tables = np.stack([np.packbits(np.bitwise_count(values[:, None] ^ prints[None, :, b]) <= NEAR, axis=1) for b in range(BLOCKS)])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, member) of all pairs that differ in RADIUS bits or fewer."""
        near = self.tables[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            near = near | self.tables[b][prints[:, b]]
        q, i = np.nonzero(np.unpackbits(near, axis=1, count=len(self.members)))
        ok = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint64)[q] ^ self.prints[i]).sum(1) <= RADIUS
        return q[ok], i[ok]


class Benchmark:
    """Items with their shingles, and their fingerprints by length. `weights` are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], weights: Weights | None = None):
        hashes = WordHashes()
        self.weights = weights or Weights.of(items)
        self.weight = self.weights.table()
        self.ids, self.lengths, self.sets, self.total = [], [], [], []
        #: shingle -> lengths of the items with it
        owners: dict[int, set[int]] = defaultdict(set)
        lengths: dict[int, list[int]] = defaultdict(list)
        prints = []
        for item_id, text in items:
            k, s = _shingles(text, hashes)
            if k == 0:
                continue
            lengths[k].append(len(self.ids))
            self.ids.append(item_id)
            self.lengths.append(k)
            one = np.unique(s)
            self.sets.append(frozenset(one.tolist()))
            self.total.append(math.fsum(self.weight[_bins(one)].tolist()))
            prints.append(self.fingerprint(one))
            for x in one.tolist():
                owners[x].add(k)
        self.owners = {x: tuple(ks) for x, ks in owners.items()}
        self.groups = {k: Group(members, np.array([prints[i] for i in members], np.uint8)) for k, members in lengths.items()}
        self.widths = sorted({min(SHINGLE, k) for k in self.lengths})
        self._mark()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"weight": state["weights"].table()}
        self._mark()

    def _mark(self) -> None:
        """The bins of all items' shingles."""
        self.known = np.zeros(1 << BIN_BITS, bool)
        self.known[_bins(np.fromiter(self.owners, np.uint64, len(self.owners)))] = True

    def _votes(self, shingles: np.ndarray) -> np.ndarray:
        """Each shingle's bits times the root of its weight, so that the cosine is that of the weights; last the root itself.

        Roots are whole numbers, so that sums are the same in any order and equal sets have equal fingerprints.
        """
        bits = np.unpackbits(np.column_stack([mix(shingles), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))]).view(np.uint8), axis=1)
        out = np.ones((len(shingles), 8 * BLOCKS + 1), np.int64)
        out[:, :-1] = bits
        return out * np.rint(1024 * np.sqrt(self.weight[_bins(shingles)])).astype(np.int64)[:, None]

    def _total(self, shingles: np.ndarray) -> np.ndarray:
        return sum((self._votes(shingles[at : at + BLOCK]).sum(0) for at in range(0, len(shingles), BLOCK)), np.zeros(8 * BLOCKS + 1, np.int64))

    def fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        """BLOCKS bytes of distinct shingles: the signs of the sums of their bits."""
        votes = self._total(shingles)
        return np.packbits(2 * votes[:-1] > votes[-1])

    def fingerprints(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Those of up to WINDOWS windows s[lo:hi], whose ends both ascend, each shingle once for each window."""
        running = lambda part: np.concatenate([np.zeros((1, 8 * BLOCKS + 1), np.int64), np.cumsum(self._votes(part), axis=0)])
        out = self._total(s[lo[0] : hi[0]]) + running(s[hi[0] : hi[-1]])[hi - hi[0]] - running(s[lo[0] : lo[-1]])[lo - lo[0]]
        part = s[lo[0] : hi[-1]]
        order = np.argsort(part, kind="stable")
        same = part[order][1:] == part[order][:-1]
        if same.any():  # a shingle that the window has before is taken out, of all windows that hold both
            before, again = order[:-1][same], order[1:][same]
            first, last = np.searchsorted(hi - lo[0], again, "right"), np.searchsorted(lo - lo[0], before, "right")
            both = np.flatnonzero(first < last)
            extra = np.zeros((len(lo) + 1, out.shape[1]), np.int64)
            for at in range(0, len(both), BLOCK):
                some = both[at : at + BLOCK]
                votes = self._votes(part[again[some]])
                np.add.at(extra, first[some], votes)
                np.subtract.at(extra, last[some], votes)
            out -= np.cumsum(extra, axis=0)[:-1]
        return np.packbits(2 * out[:, :-1] > out[:, -1:], axis=1)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Of distinct shingles with an item's."""
        weight = self.weight[_bins(window)].tolist()
        both = math.fsum(w for w, x in zip(weight, window.tolist(), strict=True) if x in self.sets[item])
        return both / (self.total[item] + math.fsum(weight) - both)

    def matches(self, text: str | None, hashes: WordHashes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of each item that has one."""
        h = hashes.of(words_of(text))
        best: dict[int, tuple[float, int, int]] = {}
        for width in self.widths:
            if len(h) < width:
                continue
            s = shingle_hashes(h, width)
            places: dict[int, list[int]] = defaultdict(list)
            for at in np.flatnonzero(self.known[_bins(s)]).tolist():
                for k in self.owners.get(int(s[at]), ()):
                    if min(k, SHINGLE) == width:
                        places[k].append(at)
            for k, hits in places.items():
                self._slide(s, k, width, np.array(hits), best)
        return [(i, start, n, sim) for i, (sim, start, n) in sorted(best.items())]

    def _slide(self, s: np.ndarray, k: int, width: int, hits: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        """Compare all windows of k words that hold one of the shingles at `hits` with the items of k words."""
        span, group = k - width + 1, self.groups[k]
        marks = np.zeros(len(s) + span + 1, np.int32)  # by start, from 1 - span on
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + span, -1)
        starts = np.flatnonzero(np.cumsum(marks) > 0) - (span - 1)
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1)
        for run in runs:
            for at in range(0, len(run), WINDOWS):
                lo, hi = np.maximum(run[at : at + WINDOWS], 0), np.minimum(run[at : at + WINDOWS] + span, len(s))
                for q, i in zip(*(x.tolist() for x in group.within(self.fingerprints(s, lo, hi))), strict=True):
                    item, start, n = group.members[i], int(lo[q]), int(hi[q] - lo[q]) + width - 1
                    sim = self.similarity(np.unique(s[lo[q] : hi[q]]), item)
                    if sim >= LEAST - 1e-12 and (item not in best or (sim, -start, -n) > (best[item][0], -best[item][1], -best[item][2])):
                        best[item] = (sim, start, n)


def _parts(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in parts of bounded size, with the weights of the whole."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(chars / MOST_CHARS))
    # at most a row for each bin
    counts = small_batches(items).select("text").mapInArrow(_count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    some = counts["bin"] >= 0
    weights = Weights(int(counts["n"][~some].sum()), counts["bin"][some].to_numpy(np.int64), counts["n"][some].to_numpy(np.int64))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Benchmark([tuple(r) for r in rows.collect()], weights)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, first_word, n_words, similarity).

    A row for each document and item of which some window has a weighted similarity of 0.75 or more: the best one, of
    equal ones the first, then the shortest. Items of under five words match as a whole sequence. Texts or items that are
    null or have no words match nothing. Texts of any length are taken whole, in bounded sets of windows; a benchmark of over
    MOST_CHARS characters is taken in parts, each of which reads the documents once more. Null ids stay null; repeated rows,
    also of items, give their rows again; other columns are ignored; empty tables give no rows.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in _parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], part: Benchmark = part) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for rows in column_slices(batches):
                found = [(d, part.ids[i], start, k, sim) for d, t in zip(rows["doc_id"], rows["text"], strict=True) for i, start, k, sim in part.matches(t, hashes)]
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        one = docs.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() has no match for; no shuffle.

    Rows with a null or empty text stay, repeated rows stay or go together, whatever their ids; an empty table, or an empty
    benchmark, changes nothing.
    """
    require(docs, "text")
    at = small_batches(docs).columns.index("text")
    for part in _parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], part: Benchmark = part) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not part.matches(t, hashes) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
