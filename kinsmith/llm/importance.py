"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of the raw text (all documents) and one of the target text
(documents labelled good and not toxic, from a bounded sample of labels). A document's n-grams are the 1-grams of its
words and of their beginnings, and the 2-grams of their shapes and repetition. Each n-gram's log ratio log((target count
+ 1) / (expected count + 1)) compares both models; add-one on the count scale leaves rare n-grams near 0. Beside it, the
deviance of the target count from the expected one says how surely an n-gram is too rare in the target text. A document of
the target sample is judged by the counts without its own.

A plain sum of log ratios can't tell a toxic document, which has a few words that the target lacks among hundreds that it
has (README has the figures), so a logistic regression on few summaries of a document's log ratios, fitted on the sample,
makes them the log weight. The k documents of largest log weight + Gumbel noise of scale 1 are kept, which samples k without
replacement in proportion to the weights. k is a share of the documents, a parameter; by default that of the target among
the labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsmith.llm.common import column_slices, materialize, mix, require, small_batches

WORD_BITS, SHAPE_BITS, START_BITS = 17, 16, 16
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + (1 << START_BITS)
#: Bytes of a word's beginning; deviance from which on an n-gram is surely too rare in the target.
START, SURE = 4, 8.0
#: Share of the expected count under which an n-gram can be too rare.
RARE = 0.25
#: Labelled documents, at most, that the target model and the regression are fitted on: those of least hash.
MOST_LABELS = 20_000
SEED = 17
FEATURES = ("mean_ratio", "bad_mass", "bad_share", "sure_mass", "repeat_share", "log_words")
_RUNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"(.)\1+", re.DOTALL), rb"\1"))


class _Codes(dict):
    """word -> hashes of the word (24 bits), its shape and its beginning (20 each); bounded as it is cleared when large."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        h = xxhash.xxh3_64_intdigest
        self[word] = code = (h(word) & 0xFFFFFF) | (h(shape) & 0xFFFFF) << 24 | (h(word[:START]) & 0xFFFFF) << 44
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _grams(codes: _Codes, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the word, the shape and the beginning n-grams, whether a word repeats the one before, the texts' ends."""
    words: list[bytes] = []
    ends = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words += text.encode("utf-8", "surrogatepass").split()
        ends[i] = len(words)
    c = codes.of(words)
    word, shape, start = c & np.uint64(0xFFFFFF), (c >> np.uint64(24)) & np.uint64(0xFFFFF), c >> np.uint64(44)
    again = np.zeros(len(c), np.uint64)
    again[1:] = c[1:] == c[:-1]
    prev = np.zeros(len(c), np.uint64)
    prev[1:] = shape[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    first = starts[starts < len(c)]
    again[first], prev[first] = 0, 0
    with np.errstate(over="ignore"):
        two = mix(shape * np.uint64(0x9E3779B97F4A7C15) + prev * np.uint64(3) + again)
        parts = (mix(word + np.uint64(1)), two, mix(start + np.uint64(7)))
    buckets, base = [], 0
    for part, bits in zip(parts, (WORD_BITS, SHAPE_BITS, START_BITS), strict=True):
        buckets.append((part >> np.uint64(64 - bits)).astype(np.int64) + base)
        base += 1 << bits
    return buckets, again, ends


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, raw, target = _Codes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in column_slices(batches):
        grams, _, ends = _grams(codes, part["text"])
        doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        good = np.array([g == 1 for g in part["good"]], bool)
        for kind, g in enumerate(grams):
            own = doc
            if kind != 1:  # words and beginnings count once a document, as repetition in junk says nothing of a word
                once = np.unique(doc * BUCKETS + g)
                own, g = once // BUCKETS, once % BUCKETS
            raw += np.bincount(g, minlength=BUCKETS)
            target += np.bincount(g[good[own]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _ratio(target: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (expected + 1)).astype(np.float32)


def _surely_rare(target: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """By how much the deviance of a count well under the expected one is over SURE."""
    deviance = expected - target + target * np.log(np.maximum(target, 1) / np.maximum(expected, 1e-9))
    return np.where(target < RARE * expected, np.maximum(deviance - SURE, 0), 0).astype(np.float32)


def _features(models: Models, codes: _Codes, texts: list[str | None], good: list[int | None]) -> list[np.ndarray]:
    """Summaries of each text's n-grams; `good` texts are judged by target counts without their own."""
    grams, again, ends = _grams(codes, texts)
    n = np.diff(np.concatenate([[0], ends]))
    r1, r2 = models.ratio[grams[0]], models.ratio[grams[1]]
    mass = [models.sure[grams[0]], models.sure[grams[2]]]
    own = np.flatnonzero(np.repeat(np.array([g == 1 for g in good], bool), n))
    if len(own):
        doc = np.repeat(np.arange(len(n)), n)[own]
        less = lambda g, k: (np.maximum(models.target[g] - k, 0), models.expected[g])
        for part, g in zip(mass, (grams[0][own], grams[2][own]), strict=True):
            part[own] = _surely_rare(*less(g, 1))
        r1[own] = _ratio(*less(grams[0][own], 1))
        _, at, times = np.unique(doc * BUCKETS + grams[1][own], return_inverse=True, return_counts=True)
        r2[own] = _ratio(*less(grams[1][own], times[at]))
    some = np.maximum(n, 1)
    bad = np.minimum(r1 + 1.5, 0) + np.minimum(r2 + 1.5, 0)
    return [_sums(r1 + r2, ends) / some, np.log1p(np.maximum(-_sums(bad, ends), 0)), _sums(bad < 0, ends) / some, np.log1p(np.maximum(_sums(mass[0] + mass[1], ends), 0)), _sums(again, ends) / some, np.log1p(n)]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method on standardized columns; weights for the columns as they are, and a constant."""
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step / max(1.0, np.abs(step).max() / 3)  # bounded, for samples that a plane separates
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ center
    return w


def _sample(labels: DataFrame) -> DataFrame:
    """doc_id and good (0 or 1), for a bounded number of labelled documents; the worst of a document's labels holds."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when((F.col("quality") >= 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    # about twice as many as needed by another hash, so that few rows are sorted however many there are
    one = materialize(one, "labelled")
    chance = min(1.0, 2 * MOST_LABELS / max(1, one.count()))
    some = one.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30))))
    return some.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(MOST_LABELS)


def _noise(doc_id: Column) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    return -F.log(-F.log(u))


class Models:
    """Target counts by bucket, and how many the raw counts let expect; each kind of n-gram is a model of its own."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.target, self.expected, at = target.astype(np.float64), np.zeros(BUCKETS), 0
        for bits in (WORD_BITS, SHAPE_BITS, START_BITS):
            part = slice(at, at + (1 << bits))
            self.expected[part] = raw[part] * (target[part].sum() / max(1.0, raw[part].sum()))
            at += 1 << bits
        self.ratio, self.sure = _ratio(self.target, self.expected), _surely_rare(self.target, self.expected)

    def features(self, rows: DataFrame) -> DataFrame:
        """`rows`, which end with good and _text, with each feature instead of _text. One pass, without a shuffle."""
        models, kept = self, rows.schema.fields[:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = _Codes()
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = _features(models, codes, part.column(len(kept)).to_pylist(), part.column(len(kept) - 1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *map(pa.array, found)], [*(f.name for f in kept), *FEATURES_AS])

        return rows.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in FEATURES_AS)]))


def _scored(featured: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """log_weight: null for documents without words, 0 if there was nothing to fit on. key: with the noise."""
    weight: Column = F.lit(0.0)
    if weights is not None:
        weight = F.lit(float(weights[-1]))
        for c, w in zip(FEATURES_AS, weights, strict=False):
            weight = weight + F.col(c) * F.lit(float(w))
    weight = F.when(F.col("_log_words") > 0, weight)
    return featured.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + _noise(F.col("doc_id")))


FEATURES_AS = tuple(f"_{c}" for c in FEATURES)


def _kth_largest(keys: DataFrame, k: int, steps: int = 4096) -> float:
    """The k-th largest `key`: the interval that holds it is cut into `steps` until its ends are next to each other.

    Only counts by cut go to the driver, never keys.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return lo
    above = 0
    while np.nextafter(lo, np.inf) < hi:
        width = (hi - lo) / steps
        if lo + width == lo:
            break
        cut = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(steps - 1)).cast("int")
        found = dict(keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(cut.alias("cut")).agg(F.struct(F.count(F.lit(1)), F.min("key"), F.max("key"))).collect())
        for c in sorted(found, reverse=True):
            if above + found[c][0] >= k:
                break
            above += found[c][0]
        count, lo, hi = found[c]
        if count == 1:
            return lo
    return lo if lo == hi else float(np.partition(np.array([r[0] for r in keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).select("key").distinct().collect()]), 0)[0])


def _selected(docs: DataFrame, labels: DataFrame, share: float | None, carried: list[Column]) -> DataFrame:
    """The rows of docs that are kept, with the columns `carried`, doc_id, log_weight and key.

    N-grams are cut twice: to count, and to judge by the counts. What is judged becomes a table with all that is carried.
    """
    sample = materialize(_sample(labels), "labels")
    rows = small_batches(docs).select(*carried, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    marked = rows.join(F.broadcast(sample), "doc_id", "left")  # bounded by MOST_LABELS
    counts = marked.select(F.col("_text").alias("text"), "good").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    others = [c for c in marked.columns if c not in ("good", "_text")]
    featured = materialize(Models(raw, target).features(marked.select(*others, "good", "_text")), "features")
    # a row for each labelled document, so MOST_LABELS at most; of rows that share a doc_id the least
    known = featured.where("good is not null and _log_words > 0").groupBy("doc_id").agg(F.min(F.struct("good", *FEATURES_AS)).alias("f")).select("f.*").toPandas().sort_values(["good", *FEATURES_AS])
    weights = None
    if 0 < known["good"].sum() < len(known):
        weights = _fit(known[list(FEATURES_AS)].to_numpy(np.float64), known["good"].to_numpy(np.float64))
    if share is None:
        share = float(known["good"].mean()) if weights is not None else 1.0
    scored = _scored(featured, weights)
    keys = scored.where("key is not null").select("key")
    k = round(share * keys.count())
    least = _kth_largest(keys, k) if k else np.inf
    return scored.where(F.col("key") >= F.lit(float(least)))


def importance_sample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality, toxic) -> (doc_id, log_weight, key) of the documents kept.

    Kept is `share` of the documents with words, by default the target's share of the labelled ones; documents without
    words are never kept. With labels of one kind only, or none, there is nothing to fit, all weights are 0 and by default all
    are kept. Null doc_id: scored as any other. Repeated rows have equal keys; rows that tie with the k-th key are all kept.
    Labels with nulls are left out; the worst of a document's labels holds. Texts of any length are taken whole. Empty
    tables give no rows; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality", "toxic")
    return _selected(docs, labels, share, []).select("doc_id", "log_weight", "key")


def keep_good(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of docs that importance_sample() keeps, with all their columns; texts are not shuffled."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality", "toxic")
    # a whole row is one value, so that no column's name can clash
    return _selected(docs, labels, share, [F.struct(*docs.columns).alias("row")]).select("row.*")
