"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

A sketch has `bands * rows` coordinates. In each of the first T rounds every element is hashed to one bin with a value
that starts with the round's number, and a bin keeps its least value; in rounds T to 2T - 1 round T + i puts every
element into bin i. So every coordinate is filled, the work is about |set| + T log T instead of |set| * T, and the
number of agreeing coordinates concentrates about the Jaccard similarity. With 50 bands of 5 rows a pair at exactly 0.75
shares no band with probability (1 - 0.75^5)^50 = 1.3e-6, and far less above.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import WordHashes, column_slices, discard, materialize, mix, require, shingle_hashes, small_batches, words_of
from kinsmith.llm.graph import connected_components

SHINGLE, BANDS, ROWS = 5, 50, 5
#: Similarity of a link, in hundredths.
PERCENT = 75
#: A block of members compared in one task holds about this many rows, or this many characters, at most.
BLOCK_ROWS, BLOCK_CHARS = 1024, 8_000_000
#: Size bound of the broadcast that thins out documents before texts are shuffled.
HASH_BUCKETS = 1 << 20
_LOW32, _S32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_STEP = np.uint64(0xD1B54A32D192ED03)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(hashes.of(words_of(text)), SHINGLE))


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The filled bins of a set that isn't empty."""
    out, n, i = np.full(size, _EMPTY), len(elements), 0
    per_step = max(1, 2400 // n)
    with np.errstate(over="ignore"):
        while i < size:
            k = min(per_step, size - i)
            rounds = np.arange(i, i + k, dtype=np.uint64)[:, None]
            x = mix(elements[None, :] + rounds * _STEP)
            bins = ((x >> _S32) * np.uint64(size)) >> _S32
            np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds << _S32) | (x & _LOW32)).ravel())
            i += k
            if out.max() != _EMPTY:
                return out
        for b in np.flatnonzero(out == _EMPTY):
            r = np.uint64(size + int(b))
            out[b] = (r << _S32) | (mix(elements + r * _STEP) & _LOW32).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = coordinates.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key ^ grid[:, j]) + _STEP
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in column_slices(batches):
        sizes, digests, keys = [], [], []
        for text in part["text"]:
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(band_keys(sketch(s, BANDS * ROWS), BANDS, ROWS) if len(s) else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part["doc_id"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64()))],
            ["doc_id", "n_shingles", "digest", "keys"],
        )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on full sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b), mostly with equal b in a row -> the links (a, b)."""
    hashes, known = WordHashes(), OrderedDict()
    for part in column_slices(batches, 64):
        a_out, b_out = [], []
        for a, b, text_a, text_b in zip(part["a"], part["b"], part["text_a"], part["text_b"], strict=True):
            if (key := (b, len(text_b))) not in known:
                known[key] = text_b, shingle_set(text_b, hashes)
                if len(known) > 8:
                    known.popitem(last=False)
            if known[key][0] != text_b:  # rows that share a doc_id
                known[key] = text_b, shingle_set(text_b, hashes)
            if linked(shingle_set(text_a, hashes), known[key][1]):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components that meet in one block; pairs already in one component are not compared."""
    hashes = WordHashes()
    group = group.sort_values(["rep"], kind="stable")
    reps, text = group["rep"].to_numpy(), group["text"].tolist()
    _, comp = np.unique(group["component"].to_numpy(), return_inverse=True)
    comp, chunk = comp.astype(np.int64), group["chunk"].to_numpy()
    across = bool(group["ci"].iloc[0] != group["cj"].iloc[0])
    sets = [shingle_set(t, hashes) for t in text]
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, np.int32)
    links = []
    major = np.bincount(comp).argmax()
    for i in np.flatnonzero(comp != major):  # of any pair between components, one is not in the largest
        other = comp != comp[i]
        if across:
            other &= chunk != chunk[i]
        if not other.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        hit = np.flatnonzero(other & (100 * both >= PERCENT * (sizes + sizes[i] - both)))
        for j in hit:
            if comp[j] != comp[i]:
                links.append((int(reps[i]), int(reps[j])))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _hashed(name: str) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), F.lit(HASH_BUCKETS))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row.

    Exact copies (equal shingle sets) are one node, named by their least doc_id, so a group of any number of copies costs
    as one document. Buckets yield stars about their least member, of which each member checks its most frequent one
    first; buckets that still hold more than one component are compared in blocks, without limit on their size.

    Rows without words, or with a null text: n_shingles 0, linked with nothing. Null doc_id: component_id null and kept
    true, linked with nothing. Rows that share a doc_id are one node. Texts of any length are taken whole. Empty tables give
    no rows; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, keys array<long>"), "signatures")
    has = signed.where("digest is not null and doc_id is not null")
    reps = materialize(has.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    unique = has.join(reps.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    bands = unique.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    buckets = (
        bands.groupBy("key")
        .agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("sig"))
        .where("lead < last")
        .groupBy("lead", "last", "n", "sig")  # buckets of the same members are one
        .agg(F.min("key").alias("key"))
        .select("key", "lead")
    )
    members = materialize(bands.join(buckets, "key").select("key", "lead", "rep"), "members")
    needed = members.select("rep").distinct()
    # most documents are in no bucket: a broadcast of at most HASH_BUCKETS numbers drops nearly all of them before the shuffle
    some = needed.select(_hashed("rep").alias("bucket")).distinct()
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")  # rows that share a doc_id may have none
    near = docs.where(F.col("doc_id").isNotNull() & has_words).join(F.broadcast(some), _hashed("doc_id") == F.col("bucket"), "left_semi")
    texts = materialize(near.join(needed, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep", "text"]), "texts")

    stars = members.where("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("rep").agg(F.max(F.struct("c", (-F.col("lead")).alias("neg"))).alias("best"))
    first = materialize(stars.select(F.col("rep").alias("a"), (-F.col("best.neg")).alias("b")), "stars")
    pairs = first.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialize(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "links")
    by_stars = connected_components(links)
    found = materialize(by_stars, "components")
    discard(by_stars)

    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "lead", "rep", F.coalesce("component", "rep").alias("component"))
    placed = placed.join(texts.select("rep", F.length("text").cast("long").alias("chars")).groupBy("rep").agg(F.max("chars").alias("chars")), "rep")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where("lo < hi")
    mixed = mixed.select(F.col("key").alias("k"), F.when(F.col("n") > 2, F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS))).otherwise(F.lit(1)).cast("int").alias("chunks"), "n")
    rest = placed.join(mixed, F.col("key") == F.col("k"))
    # a bucket of two that its star has already compared is settled
    settled = rest.where("n = 2 and rep <> lead").join(first, (F.col("rep") == F.col("a")) & (F.col("lead") == F.col("b")), "left_semi").select("key")
    rest = rest.join(settled, "key", "left_anti").select("key", "rep", "component", "chunks", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"))
    blocks = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("key", "rep", "component", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    more = blocks.join(texts, "rep").groupBy("key", "ci", "cj").applyInPandas(_block_links, "a long, b long")
    components = connected_components(links.unionByName(more)).withColumnRenamed("node", "rep")
    discard(members, texts, first, links, found)
    named = reps.join(components, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that near_duplicates() doesn't keep.

    Of rows that share a doc_id one stays. Rows with a null doc_id or without words all stay. Rows that no decision
    touches are told by a bounded broadcast and don't move.
    """
    found = materialize(near_duplicates(docs), "kept")
    touched = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept")).where("n > 1 or not kept")
    touched = materialize(touched, "touched")
    some = F.broadcast(touched.select(_hashed("id").alias("bucket")).distinct())
    # a whole row is one value, so that no column's name can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"))
    far = keyed.join(some, _hashed("key") == F.col("bucket"), "left_anti")
    near = keyed.join(some, _hashed("key") == F.col("bucket"), "left_semi").join(touched, F.col("key") == F.col("id"), "left").where("kept is null or kept")
    once, again = near.where("coalesce(n, 1) = 1"), near.where("n > 1").dropDuplicates(["key"])
    return far.select("row").unionByName(once.select("row")).unionByName(again.select("row")).select("row.*")
